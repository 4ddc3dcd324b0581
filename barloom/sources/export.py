"""Exports of results. Tables are written by Spark; reports format rows that are few by nature."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADE_COLUMNS = ["direction", "qty", "entry_price", "entry_ts", "exit_price", "exit_ts", "pnl", "commission", "mae", "mfe", "exit_reason"]


def fixed(c: str, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c)


def trades_table(trades: DataFrame) -> DataFrame:
    """Eleven columns, prices and results with six decimals."""
    plain = {"direction", "entry_ts", "exit_ts", "exit_reason"}
    return trades.select(*[F.col(c) if c in plain else fixed(c) for c in TRADE_COLUMNS])


def ranked_runs(runs: DataFrame, top: int = 10) -> DataFrame:
    """Rank, score, parameters as JSON, and figures of the best runs by score."""
    params = F.regexp_replace("run_id", "^[^:]+:", "")
    metrics = ["total_return_percent", "sharpe_ratio", "sortino_ratio", "max_drawdown_percent", "win_rate", "profit_factor", "total_trades"]
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "run_id"))
    return runs.orderBy(F.desc("score"), "run_id").limit(top).select(rank.alias("rank"), "score", params.alias("parameters"), *metrics)


def walk_forward_table(results: DataFrame, names: list[str]) -> DataFrame:
    """One column per parameter, in order, then the pairs of figures."""
    params = F.from_json(F.regexp_replace("run_id", "^[^:]+:", ""), "map<string,double>")
    figures = [c for c in results.columns if c.startswith(("is_", "oos_"))]
    return results.select("rank", *[params[n].alias(f"param_{n}") for n in sorted(names)], *figures, "degradation")


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write as CSV with header, JSON lines or Parquet."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no export as {kind}")


def surface_rows(points: DataFrame, bucket_size: float) -> DataFrame:
    """Cells in surface order, with the probability rounded to four digits."""
    return points.select((F.col("bucket") * bucket_size).alias("distance"), "minutes_remaining", "samples", F.round("probability", 4).alias("probability"), "confidence").orderBy("distance", F.desc("minutes_remaining"))


def surface_json(points: DataFrame, bucket_size: float, meta: dict) -> str:
    """A surface (bounded by buckets and minutes) with its description."""
    return json.dumps({"metadata": meta, "surface": [r.asDict() for r in surface_rows(points, bucket_size).collect()]})


def surface_html(points: DataFrame, bucket_size: float, title: str) -> str:
    rows = surface_rows(points, bucket_size).collect()
    minutes = sorted({r["minutes_remaining"] for r in rows}, reverse=True)
    cells = {(r["distance"], r["minutes_remaining"]): r["probability"] for r in rows}
    head = "".join(f"<th>{m}</th>" for m in minutes)
    shade = lambda p: "" if p is None else f' style="background:rgba(200,60,60,{p:.2f})"'
    body = "".join(f"<tr><th>{d:.6g}</th>" + "".join(f"<td{shade(cells.get((d, m)))}>{cells.get((d, m), '')}</td>" for m in minutes) + "</tr>" for d in sorted({r["distance"] for r in rows}))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th></th>{head}</tr>{body}</table></body></html>"


def report_markdown(report: dict) -> str:
    """The verdict of a validation, test by test."""
    lines = ["# Validation", "", "| Test | Result |", "|-|-|"]
    for name, ok in report["checks"].items():
        lines.append(f"| {name} | {'skipped' if ok is None else 'pass' if ok else 'fail'} |")
    return "\n".join([*lines, "", f"Overall: {'pass' if report['passed'] else 'fail'}"])


def envelope(command: str, data=None, error: str | None = None) -> str:
    return json.dumps({"command": command, "success": error is None, "data": data, "error": error}, default=str)
