"""Train, test and validation splits: planned on the driver from ranges, cut by filters in Spark."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import closed_range, stripe_ordinal
from ..sources import store
from ..sources.bundle import copy_tree
from ..sources.panel import TEST, TRAIN, VAL, full_frame, plain, read_task, timestamp_column, write_json

FAMILIES = ("fixed", "rolling", "random_block", "stripe")
UNITS = ("month", "week", "day", "hour")
PRESETS = ("none", "volume-variety")
TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class SplitConfig:
    families: tuple[str, ...] = ("rolling", "random_block", "stripe")
    count: int = 6
    seed: int = 0
    purge_hours: int = 24
    stripe_units: tuple[str, ...] = ("month", "week")
    preset: str = "volume-variety"

    def __post_init__(self):
        if self.preset not in PRESETS:
            raise ValueError(f"preset must be among {PRESETS}")
        if not self.families or set(self.families) - set(FAMILIES):
            raise ValueError(f"families must be among {FAMILIES}")
        if self.count < 1 or self.purge_hours < 0 or set(self.stripe_units) - set(UNITS):
            raise ValueError("count must be positive, purge_hours not negative, stripe units known")


def config_of(preset: str | None = None, families: str | None = None, count: int | str = 1, seed: int | str = 0, stripe_units: str | None = None, purge_hours: int | str = 24) -> SplitConfig:
    """A configuration from settings as text, lists comma-separated; what is missing is the default, counts are at least 1, hours at least 0."""
    listed = lambda text, default: tuple(x.strip() for x in (text or "").split(",") if x.strip()) or default
    own = SplitConfig()
    return SplitConfig(
        listed(families, own.families), max(1, int(count)), int(seed), max(0, int(purge_hours)), listed(stripe_units, own.stripe_units), preset or "none",
    )


@dataclass(frozen=True)
class ValidationConfig:
    split: str = "none"
    stripe_unit: str = "month"
    stripe_modulus: int = 2
    stripe_holdout: int = 1

    def __post_init__(self):
        if self.split not in ("none", "is-month-stripe") or self.stripe_unit not in UNITS:
            raise ValueError("unknown validation split or unit")
        if self.stripe_modulus < 2 or not 0 <= self.stripe_holdout < self.stripe_modulus:
            raise ValueError("holdout must be below a modulus of two or more")


@dataclass(frozen=True)
class SplitSpec:
    name: str
    family: str
    base_task: str
    seed: int = 0
    purge_hours: int = 0
    train: tuple[datetime, datetime] | None = None
    tests: tuple[tuple[datetime, datetime], ...] = ()
    details: dict = field(default_factory=dict)


def month_floor(t: datetime) -> datetime:
    return t.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def add_months(t: datetime, months: int) -> datetime:
    """The same day that many months on, or the month's last day."""
    k = t.year * 12 + t.month - 1 + months
    start = datetime(k // 12, k % 12 + 1, 1)
    last = (datetime((k + 1) // 12, (k + 1) % 12 + 1, 1) - start).days
    return t.replace(year=start.year, month=start.month, day=min(t.day, last))


def time_range(df: DataFrame) -> tuple[datetime, datetime]:
    c = timestamp_column(df)
    return tuple(df.agg(F.min(c), F.max(c)).first())


def month_calendar(df: DataFrame) -> DataFrame:
    """Months from the first to the last row."""
    c = timestamp_column(df)
    ends = df.agg(F.min(F.trunc(c, "month")).alias("a"), F.max(F.trunc(c, "month")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def rolling(low: datetime, high: datetime, train: int = 36, test: int = 12, step: int = 12) -> list[tuple[tuple, tuple]]:
    """(train range, test range) pairs; the last test range may reach beyond the data."""
    start, out = month_floor(low), []
    while (begin := add_months(start, train)) <= high:
        out.append(((start, begin - TICK), (begin, min(add_months(begin, test) - TICK, high))))
        start = add_months(start, step)
    return out


def random_blocks(low: datetime, high: datetime, rng: random.Random, block: int = 2, most: int = 12) -> tuple[tuple[datetime, datetime], ...]:
    """Disjoint test blocks of ``block`` whole months, drawn at random from a grid; none where there are fewer months.

    There are ``most`` blocks, or as many as fit. Of the grids (by their first month) one that holds so many is drawn.
    """
    first = month_floor(low)
    months = (high.year - first.year) * 12 + high.month - first.month + 1
    if months < max(block, 2):
        return ()
    n = min(most, months // block)
    grids = [range(k, months - block + 1, block) for k in range(block)]
    grid = rng.choice([g for g in grids if len(g) >= n])
    return tuple((add_months(first, k), add_months(first, k + block) - TICK) for k in sorted(rng.sample(grid, n)))


def plan(base_task: str, train: DataFrame, test: DataFrame, config: SplitConfig) -> list[SplitSpec]:
    """Candidates of each family, taken in turn until there are ``count``."""
    a, b = time_range(train), time_range(test)
    low, high = min(a[0], b[0]), max(a[1], b[1])
    rng, by = random.Random(config.seed), {}
    for family in config.families:
        own = []
        if family == "fixed":
            own = [SplitSpec("fixed-001", family, base_task, config.seed, 0, a, (b,))]
        elif family == "rolling":
            own = [SplitSpec(f"rolling-{k:03d}", family, base_task, config.seed, config.purge_hours, t, (u,)) for k, (t, u) in enumerate(rolling(low, high), 1)]
        elif family == "random_block":
            drawn = [random_blocks(low, high, rng) for _ in range(config.count)]
            own = [SplitSpec(f"random-block-{k:03d}", family, base_task, config.seed, config.purge_hours, None, d) for k, d in enumerate(drawn, 1) if d]
        else:
            own = [
                SplitSpec(f"stripe-{u}-mod2-h{h}", family, base_task, config.seed, config.purge_hours, None, (), {"unit": u, "modulus": 2, "holdout": h})
                for u in config.stripe_units for h in (0, 1)
            ]
        by[family] = own
    out, k = [], 0
    while len(out) < config.count and any(len(v) > k for v in by.values()):
        out += [v[k] for v in by.values() if len(v) > k]
        k += 1
    return out[: config.count]


def masks(df: DataFrame, spec: SplitSpec, purge_stripes: bool = False) -> tuple[Column, Column]:
    """(train, test) conditions; fixed and stripe splits do not purge unless asked to."""
    c = F.col(timestamp_column(df))
    if spec.family == "stripe":
        hit = F.pmod(stripe_ordinal(c, spec.details["unit"]), F.lit(spec.details["modulus"])) == spec.details["holdout"]
        return ~hit, hit
    test = reduce(lambda a, b: a | b, (closed_range(c, *r) for r in spec.tests))
    train = closed_range(c, *spec.train) if spec.train else ~test
    if spec.family != "fixed" and spec.purge_hours:
        train = train & purge(c, spec.tests, spec.purge_hours)
    return train, test


def purge(c: Column, ranges: tuple, hours: int) -> Column:
    """Rows farther than ``hours`` from every range."""
    d = timedelta(hours=hours)
    return ~reduce(lambda a, b: a | b, (closed_range(c, r[0] - d, r[1] + d) for r in ranges))


def cut_split(full: DataFrame, spec: SplitSpec) -> tuple[DataFrame, DataFrame]:
    train, test = (full.where(m) for m in masks(full, spec))
    if train.isEmpty() or test.isEmpty():
        raise ValueError(f"{spec.name}: a side has no rows")
    return train, test


def held_units(train: DataFrame, config: ValidationConfig) -> DataFrame:
    """(unit, is_validation) of the units present: numbered in order, every so many held out."""
    unit = stripe_ordinal(timestamp_column(train), config.stripe_unit)
    held = F.pmod(F.row_number().over(Window.orderBy("unit")) - 1, F.lit(config.stripe_modulus)) == config.stripe_holdout
    return train.select(unit.alias("unit")).distinct().withColumn("is_validation", held)


def validation(train: DataFrame, config: ValidationConfig) -> DataFrame:
    """``train`` with is_validation: its present units are numbered and every so many held out."""
    unit = stripe_ordinal(timestamp_column(train), config.stripe_unit)
    return train.withColumn("unit", unit).join(held_units(train, config), "unit").drop("unit")


def validation_metadata(config: ValidationConfig, parts: dict[str, dict]) -> dict:
    """The eleven keys that describe a validation split, from what its write observed."""
    own = {"split": config.split, "stripe_unit": config.stripe_unit, "stripe_modulus": config.stripe_modulus, "stripe_holdout": config.stripe_holdout}
    seen = {f"{side}_{k}": parts[side][k] for side in ("train", "val") for k in ("start", "end", "rows")}
    return own | {"stripe_basis": "current_is_ordinal"} | seen


def validation_report(train: DataFrame, config: ValidationConfig) -> DataFrame:
    """One row: the metadata of a validation split without writing it."""
    marked, c = validation(train, config), timestamp_column(train)
    side = {"train": ~F.col("is_validation"), "val": F.col("is_validation")}
    own = validation_metadata(config, {k: dict.fromkeys(("start", "end", "rows")) for k in side})
    mine = lambda k, x: F.when(side[k], x)
    seen = [x for k in side for x in (F.min(mine(k, F.col(c))).alias(f"{k}_start"), F.max(mine(k, F.col(c))).alias(f"{k}_end"), F.count(mine(k, F.lit(1))).alias(f"{k}_rows"))]
    named = [f"{k}_{x}" for k in side for x in ("start", "end", "rows")]
    return marked.agg(*seen).select(*(F.lit(own[k]).alias(k) for k in own if k not in named), *named)


def manifest_rows(specs: list[SplitSpec]) -> list[dict]:
    def flat(v):
        return json.dumps(v, sort_keys=True, default=str) if isinstance(v, (dict, list, tuple)) else v.isoformat() if isinstance(v, datetime) else v

    rows = []
    for s in specs:
        row = asdict(s)
        details = row.pop("details")
        rows.append({k: flat(v) for k, v in row.items()} | {f"details_{k}": flat(v) for k, v in details.items()})
    return rows


#: Columns of a manifest without any split.
NO_SPLITS = ("base_task", "task_name", "split_id", "split_family")


def write_manifest(spark: SparkSession, rows: list[dict], json_path: str | None, parquet_path: str | None = None) -> None:
    """Rows as JSON and as Parquet: one text column per key, nested values as JSON; without rows the four base columns."""
    if json_path:
        write_json(spark, json_path, rows)
    if parquet_path:
        names = list(dict.fromkeys(k for r in rows for k in r)) or list(NO_SPLITS)
        text = lambda v: None if v is None else json.dumps(plain(v), sort_keys=True) if isinstance(v, (dict, list)) else str(plain(v))
        data = [tuple(text(r.get(n)) for n in names) for r in rows]
        store.write_frame(spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names)).coalesce(1), parquet_path)


#: What a task's instruction says once it has a validation part.
MARKER = "<!-- validation part -->"
INSTRUCTION = f"""{MARKER}

## Validation

This task has a validation part besides its training data. Choose among candidates with the validation check, in which
rows of the validation part are prediction rows and their current returns are hidden. Do not read its files, and do not
train on its results; the final score comes from the test part.
"""


def add_instruction(spark: SparkSession, task: str, text: str = INSTRUCTION, marker: str = MARKER) -> bool:
    """Adds a text to a task's instruction.md, once; tells whether it was added. A task without that file stays as it is."""
    path = f"{task.rstrip('/')}/instruction.md"
    if not store.exists(spark, path):
        return False
    old = store.read_text(spark, path)
    if marker in old:
        return False
    store.write_text(spark, path, old.rstrip() + "\n\n" + text.lstrip())
    return True


#: Left out of a task's copy.
_DATA = ("*__pycache__/*", "train.parquet", "train.parquet/*", "*/train.parquet/*", "test.parquet", "test.parquet/*", "*/test.parquet/*", "val.parquet", "val.parquet/*", "*/val.parquet/*")


def _write_task(spark: SparkSession, source: str, home: str, rows: DataFrame, train: Column, test: Column, held: ValidationConfig | None) -> tuple[dict, dict | None]:
    """Copies a task's files without data and writes its parts in one job; (observed parts, validation metadata)."""
    part, c = {"train": train, "test": test}, timestamp_column(rows)
    copy_tree(spark, source, home, _DATA)
    targets = {"train": f"{home}/{TRAIN}", "test": f"{home}/{TEST}"}
    kept = [x for x in rows.columns if x != "_test"]
    if held and held.split != "none":
        unit = stripe_ordinal(c, held.stripe_unit)
        units = held_units(rows.where(train), held).select(F.col("unit").alias("_unit"), F.col("is_validation").alias("_held"))
        rows = rows.join(units, unit == F.col("_unit"), "left")
        part |= {"train": train & ~F.coalesce("_held", F.lit(False)), "val": train & F.coalesce("_held", F.lit(False))}
        targets["val"] = f"{home}/{VAL}"
    names = F.filter(F.array(*(F.when(m, F.lit(k)) for k, m in part.items())), lambda x: x.isNotNull())
    parts = store.write_parts(rows.select(*kept, names.alias("_part")), targets, c)
    if "val" not in parts:
        return parts, None
    add_instruction(spark, home)
    return parts, validation_metadata(held, parts)


def materialise(
    spark: SparkSession, source: str, target: str, config: SplitConfig, held: ValidationConfig | None = None, manifest: str | None = None, manifest_parquet: str | None = None,
) -> list[dict]:
    """Writes each planned split of a task folder: its files, train, test, optional validation, split_metadata.json.

    Each split is one job over the task's rows that writes all its parts and observes their rows and ranges. Gives back
    the manifest rows and writes them where paths are given. A split without rows on a side is an error; the preset "none"
    writes no split.
    """
    base = source.rstrip("/").rsplit("/", 1)[-1]
    train, test, _ = read_task(spark, source)
    full, out = full_frame(train, test), []
    for spec in plan(base, train, test, config) if config.preset != "none" else []:
        home = f"{target.rstrip('/')}/{base}--{spec.name}"
        parts, checked = _write_task(spark, source, home, full, *masks(full, spec), held)
        row = manifest_rows([spec])[0] | {f"{k}_rows": v["rows"] for k, v in parts.items()} | ({"details_validation": plain(checked)} if checked else {})
        write_json(spark, f"{home}/split_metadata.json", row)
        out.append(row)
    write_manifest(spark, out, manifest, manifest_parquet)
    return out


def materialise_validation(
    spark: SparkSession, sources: list[str], target: str, config: ValidationConfig, manifest: str | None = None, manifest_parquet: str | None = None,
) -> list[dict]:
    """Writes each task again with a validation part cut out of its training rows; its test rows stay as they are."""
    out = []
    for source in sources if config.split != "none" else []:
        base = source.rstrip("/").rsplit("/", 1)[-1]
        train, test, _ = read_task(spark, source)
        rows = train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)), allowMissingColumns=True)
        home = f"{target.rstrip('/')}/{base}"
        _, checked = _write_task(spark, source, home, rows, ~F.col("_test"), F.col("_test"), config)
        row = dict(zip(NO_SPLITS, (base, base, "base", "base"), strict=True)) | {"validation": plain(checked)}
        write_json(spark, f"{home}/split_metadata.json", row)
        out.append(row)
    write_manifest(spark, out, manifest, manifest_parquet)
    return out
