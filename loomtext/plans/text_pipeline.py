"""The whole way of a text: sanitize, personal data, injection, summary. As a column, as a DataFrame step and as an ML transformer."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect, pii, sanitize
from ..functions.output import collected
from ..operators.rank import outlier_scores, summarize
from ..functions.text import SENTENCE_CAP, capped, excerpt, sentence_words, sentences

# Fixed value
SUSPICIOUS = "injection-detect: WARNING -- input flagged as suspicious"


def _apart(df: DataFrame) -> DataFrame:
    """A step that the optimizer doesn't merge with the next, so what it has computed is computed once: a generator of one row, in the JVM."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def run(docs: DataFrame, text_col: str = "text", *, clean: bool = False, redact_pii: bool = False, detect_pii: bool = False, algorithm: str = "lexrank", n: int = 5, cap: int | None = SENTENCE_CAP) -> DataFrame:
    """The columns of docs and `result`: summary, tokens_in, tokens_out, reduction, warnings, invisibles_removed, pii_redactions, pii_findings.

    Stages work on what the one before left. Detection never changes the text. Of a text of more than cap sentences the first ones are summarized; cap=None lifts that.
    """
    found = docs.withColumn("_invisible", F.size(sanitize.report_invisibles(text_col)) if clean else F.lit(0))
    found = found.withColumn("_text", sanitize.sanitize(text_col) if clean else F.coalesce(F.col(text_col), F.lit("")))
    found = _apart(found) if clean else found
    report = "array<struct<pattern:string,excerpt:string,line:int>>"
    public = lambda a, line: F.transform(a, lambda f: F.struct(f["pattern"].alias("pattern"), f["excerpt"].alias("excerpt"), f[line].cast("int").alias("line")))
    if redact_pii:
        found = found.withColumn("_r", pii.redact("_text")).withColumn("_text", F.col("_r.text")).withColumn("_pii", public(F.col("_r.findings"), "line")).withColumn("_n", F.size("_pii"))
    elif detect_pii:
        found = found.withColumn("_pii", public(pii.findings("_text"), "sentence")).withColumn("_n", F.lit(0))
    else:
        found = found.withColumn("_pii", F.array().cast(report)).withColumn("_n", F.lit(0))
    warnings = F.when(detect.analyze("_text")["suspicious"], F.array(F.lit(SUSPICIOUS))).otherwise(F.array().cast("array<string>"))
    found = found.select(*docs.columns, "_text", "_invisible", "_pii", "_n", warnings.alias("_warnings"))
    if cap is not None:
        found = found.withColumn("_text", capped("_text", cap))
    found = _apart(found).withColumn("_s", summarize("_text", algorithm, n))
    result = F.struct(
        F.col("_s.summary"), F.col("_s.tokens_in"), F.col("_s.tokens_out"), F.col("_s.reduction"), F.col("_warnings").alias("warnings"),
        F.col("_invisible").alias("invisibles_removed"), F.col("_n").alias("pii_redactions"), F.col("_pii").alias("pii_findings"),
    )
    return found.select(*docs.columns, result.alias("result"))


def detect_all(docs: DataFrame, text_col: str = "text", threshold: float = 0.99) -> DataFrame:
    """The columns of docs and `report`: injection, encoding and look-alike findings, then outlying sentences, which never count as suspicious."""
    limit = threshold if threshold > 0 else 0.99
    s = sentences(text_col)
    rated = docs.withColumn("_a", detect.analyze(text_col)).withColumn("_s", s).withColumn("_o", outlier_scores(sentence_words(s)))
    both = F.zip_with("_s", "_o", lambda t, o: F.struct(t.alias("t"), o.alias("o")))
    row = lambda x, i: F.struct(detect.finding("outlier", F.lit(-1), x["o"], "cosine-outlier", excerpt(x["t"]), i).alias("f"), x["o"].alias("o"))
    out = F.transform(F.filter(F.transform(both, row), lambda x: x["o"] > limit), lambda x: x["f"])
    report = F.struct(F.concat(F.col("_a.findings"), out).alias("findings"), F.col("_a.max_score"), F.col("_a.suspicious"))
    return rated.select(*docs.columns, report.alias("report"))


def screened(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs and `found`: what a prompt hook or a detect-only run reports."""
    return docs.withColumn("found", collected(pii.findings(text_col), sanitize.report_invisibles(text_col), detect.analyze(text_col)["findings"]))


class TextPipeline(Transformer):
    """run() as a stage of an ML pipeline."""

    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)
    algorithm = Param(Params._dummy(), "algorithm", "lexrank, textrank, graph or ensemble", TypeConverters.toString)
    sentences = Param(Params._dummy(), "sentences", "sentences of a summary", TypeConverters.toInt)
    clean = Param(Params._dummy(), "clean", "remove invisible characters", TypeConverters.toBoolean)
    redactPii = Param(Params._dummy(), "redactPii", "replace personal data", TypeConverters.toBoolean)
    detectPii = Param(Params._dummy(), "detectPii", "report personal data", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, textCol="text", algorithm="lexrank", sentences=5, clean=False, redactPii=False, detectPii=False):
        super().__init__()
        self._setDefault(textCol="text", algorithm="lexrank", sentences=5, clean=False, redactPii=False, detectPii=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        return run(dataset, get(self.textCol), clean=get(self.clean), redact_pii=get(self.redactPii), detect_pii=get(self.detectPii), algorithm=get(self.algorithm), n=get(self.sentences))
