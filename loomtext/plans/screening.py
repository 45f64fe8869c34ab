"""What a run reports beside its result: hidden surfaces, injection by category, what each stage changed, alerts with severity. Native on columns of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect, pii, sanitize
from ..functions.patterns import let
from ..operators.rank import OUTLIER
from .text_pipeline import SUSPICIOUS, _apart, detect_all

# Labels of report lines, and severity by kind of finding.
INJECTION, PII, SANITIZE, HTML = "injection-detect", "pii-detect", "sanitize", "html-convert"
FLAGGED, SURFACE_FLAGGED = "WARNING — input flagged as suspicious", "WARNING — surface flagged as suspicious"
SEVERITY = {"pattern": "high", "pii": "high", "sanitized": "low"}
OTHER_SEVERITY = "medium"


def _lines(*parts: Column) -> Column:
    """One string of the lines of some arrays, nothing for empty ones."""
    return F.concat_ws("\n", F.concat(*parts))


def _if(condition: Column, *lines: Column) -> Column:
    return F.when(condition, F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _finding_line(f: Column) -> Column:
    return F.format_string("  [%s] %s (score=%.2f): %s", f["category"], f["pattern"], f["score"], f["excerpt"])


def without_outliers(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["category"] != "outlier")


def injection_report(report: Column, invisibles: Column, threshold: float = OUTLIER) -> Column:
    """Lines on invisible characters, then pattern and encoding findings, then outlying sentences, whose score is on another scale."""
    invisible = F.concat(
        _if(F.size(invisibles) > 0, F.format_string(f"{INJECTION}: %d invisible Unicode codepoint(s) found", F.size(invisibles))),
        F.transform(invisibles, lambda r: F.format_string("  offset %d: U+%04X %s (%s)", r["offset"], r["codepoint"], r["name"], r["category"])),
    )

    def said(found):
        head = F.when(F.size(found) > 0, F.format_string(f"{INJECTION}: %d finding(s), max confidence %.2f", F.size(found), report["max_score"])).otherwise(F.lit(f"{INJECTION}: no findings"))
        return F.concat(F.array(head), F.transform(found, _finding_line), _if((F.size(found) > 0) & report["suspicious"], F.lit(f"{INJECTION}: {FLAGGED}")))

    def apart(found):
        return F.concat(
            _if(F.size(found) > 0, F.format_string(f"{INJECTION}: %d outlier sentence(s) above threshold %.2f", F.size(found), F.lit(threshold))),
            F.transform(found, lambda f: F.format_string("  [outlier] sentence %d (score=%.2f): %s", f["sentence"], f["score"], f["excerpt"])),
        )

    return _lines(invisible, let(without_outliers(report["findings"]), said), let(F.filter(report["findings"], lambda f: f["category"] == "outlier"), apart))


def pii_report(findings: Column) -> Column:
    """A line on each finding, never more than its excerpt."""
    line = lambda f: F.format_string(f"{PII}: WARNING — [%s] %s (line %d)", f["pattern"], f["excerpt"], f["sentence"])
    head = F.when(F.size(findings) > 0, F.format_string(f"{PII}: %d finding(s)", F.size(findings))).otherwise(F.lit(f"{PII}: no findings"))
    return _lines(F.array(head), F.transform(findings, line))


def detect_only(docs: DataFrame, text_col: str = "text", *, injection: bool = True, personal: bool = True, threshold: float = OUTLIER) -> DataFrame:
    """The columns of docs, `report` and `diagnostics`: detection alone, the text is neither changed nor summarized."""
    found = _apart(detect_all(docs, text_col, threshold).withColumn("_pii", pii.findings(text_col)).withColumn("_inv", sanitize.report_invisibles(text_col)))
    parts = [*([pii_report(F.col("_pii"))] if personal else []), *([injection_report(F.col("report"), F.col("_inv"), threshold)] if injection else [])]
    return found.select(*docs.columns, "report", (F.concat_ws("\n", *parts) if parts else F.lit("")).alias("diagnostics"))


def surface_findings(surfaces: DataFrame, *keys: str) -> DataFrame:
    """keys, surface_idx, source, n_findings, max_score, suspicious, findings: each hidden surface (text) screened on its own; outlying sentences don't count."""
    rated = _apart(surfaces.select(*keys, "surface_idx", "source", detect.analyze("text").alias("r")))
    return rated.select(*keys, "surface_idx", "source", F.size("r.findings").alias("n_findings"), "r.max_score", "r.suspicious", "r.findings")


def surface_report(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, report: the lines on a document's surfaces, in their order; one line if there is nothing to say."""
    label = F.format_string(f"{INJECTION}[%s:%d]: ", F.col("source"), F.col("surface_idx"))
    lines = F.concat(
        F.array(F.concat(label, F.format_string("%d finding(s), max confidence %.2f", F.col("n_findings"), F.col("max_score")))),
        F.transform("findings", _finding_line), _if(F.col("suspicious"), F.concat(label, F.lit(SURFACE_FLAGGED))),
    )
    said = findings.select(*keys, F.when(F.col("n_findings") > 0, F.struct("surface_idx", lines.alias("lines"))).alias("l"))
    grouped = said.groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = F.concat_ws("\n", F.flatten(F.transform("l", lambda x: x["lines"])))
    return grouped.select(*keys, F.when(F.size("l") > 0, text).otherwise(F.lit(f"{INJECTION}[hidden-surfaces]: no findings")).alias("report"))


def conversion_figures(before: Column, after: Column) -> Column:
    """struct<bytes_before, bytes_after, percent, line> of a conversion from HTML; the percentage is cut to an integer."""
    b, a = F.coalesce(F.octet_length(before), F.lit(0)), F.coalesce(F.octet_length(after), F.lit(0))
    percent = F.when(b > 0, ((b - a) * 100 / b).cast("int")).otherwise(0)
    return F.struct(b.alias("bytes_before"), a.alias("bytes_after"), percent.alias("percent"), F.format_string(f"{HTML}: %d → %d bytes (%d%% reduction)", b, a, percent).alias("line"))


def sanitize_report(text) -> Column:
    """struct<text, removed_count, invisibles, line>: the cleaned text and what was removed; line is null if nothing was."""
    found = sanitize.report_invisibles(text)

    def of(x):
        n = F.size(x["found"])
        return F.struct(x["text"].alias("text"), n.alias("removed_count"), x["found"].alias("invisibles"), F.when(n > 0, F.format_string(f"{SANITIZE}: removed %d invisible codepoint(s)", n)).alias("line"))

    return let(F.struct(sanitize.strip_invisible(text).alias("text"), found.alias("found")), of)


def redaction_line(redactions: Column) -> Column:
    return F.format_string(f"{PII}: %d redaction(s) applied", redactions)


def detected(report: Column) -> Column:
    """struct<report, warnings>: a warning for a suspicious text."""
    return F.struct(report.alias("report"), _if(report["suspicious"], F.lit(SUSPICIOUS)).alias("warnings"))


def alerts(report: Column | None, personal: Column | None, removed: Column | None) -> Column:
    """array<struct<type, severity, message>>: characters removed, then injection findings, then personal data. None leaves a kind out."""
    alert = lambda kind, severity, message: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), message.alias("message"))
    level = lambda c: F.when(c == "pattern", SEVERITY["pattern"]).otherwise(OTHER_SEVERITY)
    parts = [F.array().cast("array<struct<type:string,severity:string,message:string>>")]
    if removed is not None:
        parts.append(F.when(removed > 0, F.array(alert("sanitized", F.lit(SEVERITY["sanitized"]), F.format_string("%d invisible Unicode chars removed", removed)))).otherwise(parts[0]))
    if report is not None:
        parts.append(F.transform(report["findings"], lambda f: alert("injection", level(f["category"]), F.concat(f["category"], F.lit(": "), f["excerpt"]))))
    if personal is not None:
        parts.append(F.transform(personal, lambda f: alert("pii", F.lit(SEVERITY["pii"]), F.format_string("%s: %s (line %d)", f["pattern"], f["excerpt"], f["sentence"]))))
    return F.concat(*parts)


def metrics(summary: Column, algorithm: str, n: int) -> Column:
    """Of rank.summarize's struct: input_tokens, output_tokens, tokens_saved, savings_percent, sentence_count, algorithm."""
    return F.struct(
        summary["tokens_in"].alias("input_tokens"), summary["tokens_out"].alias("output_tokens"), (summary["tokens_in"] - summary["tokens_out"]).alias("tokens_saved"),
        summary["reduction"].cast("double").alias("savings_percent"), F.lit(n).alias("sentence_count"), F.lit(algorithm).alias("algorithm"),
    )
