"""Where text comes from, and whether it is text."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.rank import ALGORITHMS, LEVELS

FORMATS = ("text", "json", "markdown")


def text_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def input_status(content: Column) -> Column:
    """Of binary content: binary_nul, binary_utf8, empty or ok."""
    text = F.try_validate_utf8(content.cast("string"))
    nul = F.coalesce(F.contains(content, F.lit(b"\x00")), F.lit(False))
    return F.when(nul, "binary_nul").when(content.isNotNull() & text.isNull(), "binary_utf8").when(trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("ok")


def resolve_input(url: str = "", stdin: str | None = None, path: str = "", args: list[str] = ()) -> tuple[str, str]:
    """(kind, value) of the one that counts: url before stdin before file before arguments."""
    if url:
        return "url", url
    if stdin is not None:
        return "stdin", stdin
    if path:
        return "file", path
    if args:
        return "args", " ".join(args)
    raise ValueError("no input: give a url, standard input, a file or text")


@dataclass
class Config:
    algorithm: str = "lexrank"
    sentences: int = 5
    format: str = "text"
    level: str = ""
    stats: bool = True


def parse_config(text: str | None) -> Config:
    """Of TOML; what is missing, malformed or unknown leaves the defaults."""
    try:
        raw = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return Config()
    known = {f.name: f.type for f in fields(Config)}
    own = {k: v for k, v in raw.items() if k in known and k != "stats" and type(v).__name__ == known[k]}
    config = Config(**own)
    if isinstance(raw.get("stats"), dict) and isinstance(raw["stats"].get("enabled"), bool):
        config.stats = raw["stats"]["enabled"]
    if config.sentences <= 0:
        config.sentences = 5
    return config


@dataclass
class Settings:
    algorithm: str
    sentences: int
    format: str
    flags: dict = field(default_factory=dict)


def resolve_settings(config: Config, **flags) -> Settings:
    """Configuration, then the level's number of sentences, then flags; ValueError for values that don't exist."""
    given = {k: v for k, v in flags.items() if v is not None}
    n, level = config.sentences, given.get("level", config.level)
    if level:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}: valid values are {', '.join(LEVELS)}")
        n = LEVELS[level]
    n = given.get("sentences", n)
    out = Settings(given.get("algorithm", config.algorithm), n, given.get("format", config.format), given)
    if out.format not in FORMATS:
        raise ValueError(f"unknown format {out.format!r}: valid values are {', '.join(FORMATS)}")
    if out.algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {out.algorithm!r}: valid values are {', '.join(ALGORITHMS)}")
    if out.sentences < 1:
        raise ValueError("sentences must be at least 1")
    return out
