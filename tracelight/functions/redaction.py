"""Multi-pattern redaction in column functions.

Spans come from splitting a text at a pattern: gaps and matches, summed up, give
every match's place. Spans of all patterns are sorted and folded into unions, and
each union is replaced once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARK = "[REDACTED]"

#: Names, patterns and descriptions that results depend on.
BUILTINS = (
    ("API_KEY", r"(?i)(api[_-]?key|secret|token)\s*[:=]\s*\S+", "API keys and tokens (api_key=, secret=, token=)"),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "Email addresses"),
    ("PASSWORD", r"(?i)(password|passwd|pwd)\s*[:=]\s*\S+", "Password assignments (password=, pwd=)"),
    ("AWS_KEY", r"(?i)(aws[_-]?)?(access[_-]?key[_-]?id|secret[_-]?access[_-]?key)\s*[:=]\s*\S+", "AWS access keys and secret keys"),
    ("PRIVATE_KEY", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "Private key headers"),
    ("BEARER_TOKEN", r"(?i)bearer\s+[a-zA-Z0-9_\-\.]+", "Bearer authentication tokens"),
    ("GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9_]{36,}", "GitHub personal access tokens"),
    ("GENERIC_SECRET", r"""(?i)["']?(?:secret|private|credential)[_-]?(?:key)?["']?\s*[:=]\s*["']?[^"'\s]+""", "Generic secret/credential assignments"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "US Social Security Numbers"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "Credit card numbers (Visa, MC, Amex, Discover)"),
    ("PHONE", r"\b(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "US phone numbers"),
    ("DB_CONNECTION", r"(?i)(?:mysql|postgres|postgresql|mongodb|redis|mssql|mariadb)://[^\s]+", "Database connection strings"),
    ("SLACK_TOKEN", r"xox[baprs]-[0-9A-Za-z\-]+", "Slack API tokens"),
    ("STRIPE_KEY", r"(?:sk|pk|rk)_(?:live|test)_[0-9a-zA-Z]{24,}", "Stripe API keys"),
    ("JWT_TOKEN", r"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+", "JWT tokens (JSON Web Tokens)"),
    ("GOOGLE_OAUTH", r"1//[0-9A-Za-z_-]{40,}", "Google OAuth refresh tokens"),
    ("MICROSOFT_OAUTH", r"0\.A[A-Za-z0-9_-]{80,}", "Microsoft/Azure OAuth refresh tokens"),
    ("DOCKER_REGISTRY", r"(?i)(?:docker|registry)[_-]?(?:user|pass|auth|credential)?[:\s=]+[^\s]+:[^\s]+@[^\s]+", "Docker registry credentials"),
    ("K8S_SECRET", r"(?i)(?:kubectl\s+create\s+secret|kind:\s*Secret)", "Kubernetes secret data"),
    ("BASE64_SECRET", r"""(?i)(?:secret|key|token|password|credential)[_-]?(?:data)?[:\s=]+['"]?[A-Za-z0-9+/=]{40,}['"]?""", "Base64-encoded secrets"),
    ("NPM_TOKEN", r"npm_[A-Za-z0-9]{36}", "npm authentication tokens"),
    ("PYPI_TOKEN", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", "PyPI API tokens"),
)

#: Signs without which a pattern above cannot match: lower-case words of
#: which a lowered text must hold one, signs that a text must hold, or a plainer pattern.
WORDS = {
    "API_KEY": ("api", "secret", "token"), "PASSWORD": ("passw", "pwd"), "AWS_KEY": ("access",), "BEARER_TOKEN": ("bearer",), "GENERIC_SECRET": ("secret", "private", "credential"),
    "DB_CONNECTION": ("://",), "DOCKER_REGISTRY": ("docker", "registry"), "K8S_SECRET": ("secret",), "BASE64_SECRET": ("secret", "key", "token", "password", "credential"),
}
SIGNS = {
    "EMAIL": "@", "PRIVATE_KEY": "-----BEGIN", "SLACK_TOKEN": "xox", "STRIPE_KEY": "k_", "JWT_TOKEN": "eyJ", "GOOGLE_OAUTH": "1//", "MICROSOFT_OAUTH": "0.A", "NPM_TOKEN": "npm_", "PYPI_TOKEN": "pypi-AgE", "GITHUB_TOKEN": "gh",
}
PLAINER = {"SSN": r"[0-9]-[0-9]{2}-[0-9]", "CREDIT_CARD": r"[0-9]{12}", "PHONE": r"[0-9]{4}"}
_OWN = {name: pattern for name, pattern, _ in BUILTINS}


@dataclass(frozen=True)
class Redactor:
    """Named patterns, in order. Immutable: every change gives a new one."""

    patterns: tuple[tuple[str, str, str], ...] = BUILTINS
    unicode: bool = False
    warnings: tuple[str, ...] = field(default=())

    @classmethod
    def none(cls) -> Redactor:
        return cls(())

    @classmethod
    def of(cls, patterns: list[str]) -> Redactor:
        """Unnamed patterns; those that do not compile are skipped."""
        return cls.none()._with([(f"CUSTOM_{k}", p, "") for k, p in enumerate(patterns)])

    @classmethod
    def configured(cls, enabled: bool = True, use_builtins: bool = True, disabled: tuple[str, ...] = (), custom: tuple[tuple[str, str, str], ...] = ()) -> Redactor:
        if not enabled:
            return cls.none()
        start = tuple(p for p in BUILTINS if p[0] not in set(disabled)) if use_builtins else ()
        return cls(start)._with(list(custom))

    def _with(self, more) -> Redactor:
        good, bad = [], []
        for name, pattern, about in more:
            try:
                empty = re.compile(pattern).match("") is not None
            except re.error:
                empty = True
            (bad if empty else good).append((name, pattern, about))
        return Redactor((*self.patterns, *good), self.unicode, (*self.warnings, *(f"pattern {n} was skipped" for n, _, _ in bad)))

    def adding(self, name: str, pattern: str, about: str = "") -> Redactor:
        return self._with([(name, pattern, about)])

    @property
    def names(self) -> list[str]:
        return [p[0] for p in self.patterns]

    def _regex(self, pattern: str) -> str:
        return f"(?U){pattern}" if self.unicode else pattern

    def catalogue(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *p) for k, p in enumerate(self.patterns)], "ordinal int, name string, pattern string, description string")

    # -- columns

    def _matches(self, text: Column, name: str, pattern: str) -> Column:
        """Whether a pattern matches; built-in ones look for their signs first. With
        Unicode classes other letters may stand for these, so there all texts are tried."""
        test = text.rlike(self._regex(pattern))
        if self.unicode or _OWN.get(name) != pattern:
            return test
        if name in WORDS:
            low, any_ = F.lower(text), F.lit(False)
            for word in WORDS[name]:
                any_ = any_ | F.contains(low, F.lit(word))
            return any_ & test
        return (F.contains(text, F.lit(SIGNS[name])) if name in SIGNS else text.rlike(PLAINER[name])) & test

    def contains(self, text: Column) -> Column:
        out = F.lit(False)
        for n, p, _ in self.patterns:
            out = out | self._matches(text, n, p)
        return out

    def _spans(self, text: Column, name: str, ordinal: int, pattern: str) -> Column:
        """Matches as array<struct<start, end, ordinal, name, hit>>, ends exclusive."""
        none = F.array().cast("array<struct<start:int,end:int,ordinal:int,name:string,hit:string>>")
        hits = F.regexp_extract_all(text, F.lit(self._regex(pattern)), F.lit(0))
        gaps = F.split(text, self._regex(pattern), -1)
        lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
        pairs = F.arrays_zip(lengths(gaps).alias("g"), lengths(hits).alias("h"), hits.alias("t"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["g"]
            span = F.struct(a.alias("start"), (a + x["h"]).alias("end"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("name"), x["t"].alias("hit"))
            return F.struct((a + F.coalesce(x["h"], F.lit(0))).alias("at"), F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

        return F.when(self._matches(text, name, pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)

    def events(self, text: Column) -> Column:
        """One entry per raw match of every pattern, by start, then pattern order."""
        if not self.patterns:
            return F.array().cast("array<struct<start:int,end:int,ordinal:int,name:string,hit:string>>")
        found = [self._spans(text, n, k, p) for k, (n, p, _) in enumerate(self.patterns)]
        by = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["ordinal"] - b["ordinal"])
        return F.array_sort(F.concat(*found), by)


def matches(df: DataFrame, column: str = "text", redactor: Redactor = Redactor()) -> DataFrame:
    """A row per raw match with its place: all of the first pattern, then all of the
    second, each from left to right."""
    text = F.col(column)
    by = lambda a, b: F.when(a["ordinal"] != b["ordinal"], a["ordinal"] - b["ordinal"]).otherwise(a["start"] - b["start"])
    found = df.where(redactor.contains(text)).select(*df.columns, F.posexplode(F.array_sort(redactor.events(text), by)).alias("position", "e"))
    return found.select(*df.columns, "position", "e.ordinal", "e.name", "e.start", "e.end", "e.hit")


def report(df: DataFrame, column: str = "text", redactor: Redactor = Redactor()) -> DataFrame:
    """What a redaction test prints: bytes of the input, output, number and names of the
    matches in pattern order, as columns and as one JSON text."""
    by = lambda a, b: F.when(a["ordinal"] != b["ordinal"], a["ordinal"] - b["ordinal"]).otherwise(a["start"] - b["start"])
    names = F.coalesce(F.transform(F.array_sort("events", by), lambda e: e["name"]), F.array().cast("array<string>"))
    out = redact(df, column, redactor).select(*df.columns, F.octet_length(column).alias("input_length"), F.col("redacted").alias("output"), F.size(names).alias("match_count"), names.alias("matches"))
    return out.withColumn("json", F.to_json(F.struct("input_length", "output", "match_count", "matches")))


def unions(spans: Column) -> Column:
    """Sorted spans (start, end) merged where they overlap or touch."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(spans, empty, step)


def replaced(text: Column, merged: Column, mark: str = MARK) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"))
    return F.aggregate(merged, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(df: DataFrame, column: str = "text", redactor: Redactor = Redactor()) -> DataFrame:
    """Adds redacted, events and spans. Texts without a match pass through: the
    sure and cheap test comes first, the folds only run on what holds a match."""
    text = F.col(column)
    out = df.withColumn("_hit", redactor.contains(text))
    out = out.withColumn("events", F.when(F.col("_hit"), redactor.events(text)))
    out = out.withColumn("spans", F.when(F.col("_hit"), unions(F.col("events"))))
    return out.withColumn("redacted", F.when(F.col("_hit"), replaced(text, F.col("spans"))).otherwise(text)).drop("_hit")
