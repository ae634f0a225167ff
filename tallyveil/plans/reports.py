"""Report queries: histograms by encoding, joint and raw reports, rendering, schedules and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encoding, estimate
from ..operators.rows import suppress_empty, with_labels


def _noop(obs: DataFrame, cfg: dict) -> DataFrame:
    return estimate.histogram(obs, cfg["value"]).withColumnRenamed(cfg["value"], "value")


def _basic(obs: DataFrame, cfg: dict) -> DataFrame:
    rows = estimate.basic_rappor_estimate(estimate.bit_counts(obs, len(cfg["categories"])), cfg["p"], cfg["q"])
    names = F.array(*map(F.lit, cfg["categories"]))
    return rows.select(F.get(names, "bit").alias("value"), "count_estimate", "std_error")


def _threshold(obs: DataFrame, cfg: dict) -> DataFrame:
    rows = encoding.threshold_decrypt(obs, cfg["threshold"])
    return rows.select(F.col("plaintext").alias("value"), F.col("total").alias("count_estimate"), F.lit(0.0).alias("std_error"))


#: The extension seam: an estimator for each kind of encoding.
ESTIMATORS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"noop": _noop, "basic_rappor": _basic, "threshold": _threshold}


def histogram_report(obs: DataFrame, kind: str, cfg: dict, first: int, last: int) -> DataFrame:
    """Scan of the day range, estimate by the encoding's kind: (value, count_estimate, std_error)."""
    return ESTIMATORS[kind](obs.where(F.col("day_index").between(first, last)), cfg)


def joint_counts(obs: DataFrame, v1: str, v2: str) -> DataFrame:
    """Exact two-way counts, for parts that are both unencoded."""
    return obs.groupBy(v1, v2).agg(F.count("*").alias("n"))


def marginal_reports(joint: DataFrame) -> DataFrame:
    """(variable, value, n): the one-way histograms of a two-way report, in one pass."""
    pair = F.explode(F.array(F.struct(F.lit(0).alias("variable"), F.col("v1").cast("string").alias("value")), F.struct(F.lit(1).alias("variable"), F.col("v2").cast("string").alias("value")))).alias("m")
    return joint.select(pair, "n").groupBy("m.variable", "m.value").agg(F.sum("n").alias("n"))


def _dates(first: str, last: str) -> list[Column]:
    """A report of one day has a date, another a start and an end."""
    return [S.date_string(first).alias("date")] if first == last else [S.date_string(first).alias("start_date"), S.date_string(last).alias("end_date")]


def _profile(fields: tuple[str, ...]) -> list[Column]:
    """Quoted profile fields; an unset one is an empty string."""
    return [S.csv_string(F.coalesce(f, F.lit(""))).alias(f) for f in fields]


def finished_report(rows: DataFrame, labels: DataFrame | None = None, fields: tuple[str, ...] = (), first: str = "day_index", last: str = "day_index") -> DataFrame:
    """Rows (kind, values, profile, count_estimate, std_error, days) rendered: date or dates, value, profile, count, err; empty rows go."""
    if labels is not None:
        rows = with_labels(rows, labels)
    rows = suppress_empty(rows)
    return rows.select(*_dates(first, last), S.value_to_string().alias("value"), *_profile(fields), S.format_float(S.clip_count("count_estimate")).alias("count"), S.format_float(F.greatest(F.lit(0.0), F.col("std_error"))).alias("err"))


def report_header(variables: list[str], fields: tuple[str, ...] = (), days: int = 1, counts: bool = True) -> str:
    """The header row: dates, variables, profile fields and, but for raw dumps, count and err."""
    names = {"os": "OS", "arch": "Arch", "board_name": "Board_Name", "product_name": "Product_Name"}
    clean = ["".join(c if c.isascii() and c.isalnum() else "_" for c in v[:128]) for v in variables]
    return ",".join([*(["date"] if days == 1 else ["start_date", "end_date"]), *clean, *[names[f] for f in fields], *(["count", "err"] if counts else [])])


def dump_lines(dump: DataFrame, parts: dict[str, str], labels: dict[str, DataFrame], fields: tuple[str, ...] = (), first: str = "day_index", last: str = "day_index") -> DataFrame:
    """Adds line to a raw dump: dates, each part by its type (labels for indices), and the profile.

    labels: for a part of indices, a table (idx, label).
    """
    cells = []
    for part, kind in parts.items():
        text = F.col(part).cast("string")
        if kind == "index":
            if part in labels:
                dump = dump.join(labels[part].select(F.col("idx").cast("string").alias(part), F.col("label").alias(f"label_{part}")), part, "left")
            label = S.csv_string(f"label_{part}") if part in labels else F.lit(None).cast("string")
            cells.append(F.coalesce(label, F.concat(F.lit('"<index '), text, F.lit('>"'))))
        else:
            cells.append(S.csv_string(part) if kind == "string" else S.format_float(F.col(part).cast("double")) if kind == "double" else text)
    return dump.withColumn("line", csv_line([*_dates(first, last), *cells, *_profile(fields)]))


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *columns)


def due_daily_reports(configs: DataFrame, history: DataFrame, today: int) -> DataFrame:
    """(config_id, day) due: inside the finalization window unless in progress, before it unless completed or in progress.

    history(config_id, day, state, one_off); one-off runs don't count.
    """
    span = F.greatest(F.lit(30), F.col("finalization_days"))
    days = configs.select("config_id", "finalization_days", F.explode(F.sequence(F.lit(today) - span, F.lit(today))).alias("day"))
    seen = history.where("NOT one_off").groupBy("config_id", "day").agg(F.max(F.col("state") == "IN_PROGRESS").alias("running"), F.max(F.col("state") == "COMPLETED").alias("done"))
    rows = days.join(seen, ["config_id", "day"], "left").fillna(False, ["running", "done"])
    inside = F.col("day") >= today - F.col("finalization_days")
    return rows.where(~F.col("running") & (inside | ~F.col("done"))).select("config_id", "day")


def due_epoch_reports(configs: DataFrame, history: DataFrame, today: int, epoch: str, back: int) -> DataFrame:
    """(config_id, epoch) of finished epochs, up to `back` of them, without a completed or running report."""
    now = S.epoch_index(F.lit(today), epoch)
    epochs = configs.select("config_id", F.explode(F.sequence(now - back, now - 1)).alias("epoch"))
    seen = history.where("NOT one_off AND state IN ('COMPLETED', 'IN_PROGRESS')").select("config_id", S.epoch_index("day", epoch).alias("epoch")).distinct()
    return epochs.join(seen, ["config_id", "epoch"], "left_anti")


def report_metadata(events: DataFrame) -> DataFrame:
    """The latest state of each report from append-only events (report_id, stamp, state)."""
    latest = F.max_by(F.struct("state", "stamp"), "stamp")
    return events.groupBy("report_id").agg(F.min("stamp").alias("created"), latest.alias("last")).select("report_id", "created", F.col("last.state").alias("state"), F.col("last.stamp").alias("updated"))


def report_errors(events: DataFrame) -> DataFrame:
    return events.where("message IS NOT NULL").groupBy("report_id").agg(F.count("*").alias("n_messages"), F.max_by("message", "stamp").alias("last_message"))


def popular_values(df: DataFrame, value: str, threshold: int) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
