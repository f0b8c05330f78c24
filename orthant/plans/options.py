"""Options of index builds and scans, with their ranges; scans read theirs from the session unless given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..functions.kinds import VectorError


@dataclass(frozen=True)
class Option:
    default: int | str
    low: int | None = None
    high: int | None = None
    choices: tuple[str, ...] = ()


#: Build options by index method.
BUILD = {
    "ivf": {"lists": Option(100, 1, 32768)},
    "hnsw": {"m": Option(16, 2, 100), "ef_construction": Option(64, 4, 1000)},
}
#: Scan options, named as session settings.
SCAN = {
    "ivfflat.probes": Option(1, 1, 32768),
    "ivfflat.iterative_scan": Option("off", choices=("off", "relaxed_order")),
    "ivfflat.max_probes": Option(32768, 1, 32768),
    "hnsw.ef_search": Option(40, 1, 1000),
    "hnsw.iterative_scan": Option("off", choices=("off", "relaxed_order", "strict_order")),
    "hnsw.max_scan_tuples": Option(20000, 1, 2**31 - 1),
    "hnsw.scan_mem_multiplier": Option(1, 1, 1000),
}


def build_options(method: str, **given: int) -> dict[str, int]:
    out = {}
    for name, option in BUILD[method].items():
        value = given.get(name)
        value = option.default if value is None else int(value)
        if not option.low <= value <= option.high:
            raise VectorError(f'value {value} out of bounds for option "{name}"; valid values are between "{option.low}" and "{option.high}"')
        out[name] = value
    if unknown := set(given) - set(BUILD[method]):
        raise VectorError(f'unrecognized parameter "{sorted(unknown)[0]}"')
    if method == "hnsw" and out["ef_construction"] < 2 * out["m"]:
        raise VectorError("ef_construction must be greater than or equal to 2 * m")
    return out


def scan_option(spark: SparkSession, name: str, given: int | str | None = None) -> int | str:
    option = SCAN[name]
    value = given if given is not None else spark.conf.get(name, None)
    if value is None:
        return option.default
    if option.choices:
        if value not in option.choices:
            raise VectorError(f'invalid value for parameter "{name}": "{value}" (available values: {", ".join(option.choices)})')
        return value
    try:
        number = int(value)
    except ValueError:
        raise VectorError(f'invalid value for parameter "{name}": "{value}"') from None
    if not option.low <= number <= option.high:
        raise VectorError(f'{number} is outside the valid range for parameter "{name}" ({option.low} .. {option.high})')
    return number
