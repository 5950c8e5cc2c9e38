"""Ticket and alert fields as Columns: texts, ordinals, dates, magnitudes, labels, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = " [SEP] "

# Resolutions that mark noise, in the two tracker dialects.
NOISE_RESOLUTIONS = {
    "tracker_a": ["INVALID", "DUPLICATE", "WONTFIX", "WORKSFORME", "NOT_ECLIPSE"],
    "tracker_b": ["INVALID", "DUPLICATE", "WONTFIX", "WORKSFORME", "INCOMPLETE"],
}

# Ordinal scales.
SEVERITY = {"blocker": 5, "critical": 4, "major": 3, "normal": 2, "minor": 1, "trivial": 0, "enhancement": -1}
PRIORITY = {"P1": 4, "P2": 3, "P3": 2, "P4": 1, "P5": 0}

# Alert status codes.
ALERT_STATUS = {0: "untriaged", 1: "downstream", 2: "reassigned", 3: "invalid", 4: "acknowledged"}
GROUP_STATUS_MERGE = {8: 4, 2: 4}

# Patterns behind the report-quality flags.
QUALITY_PATTERNS = {
    "has_steps": r"steps?\s*to\s*reproduce|1\.\s|step\s*1",
    "has_stacktrace": r"Exception|at\s+org\.|Caused\s+by|stacktrace|traceback",
    "has_expected_actual": r"expected|actual|should\s+be|instead\s+of",
    "has_version": r"\d+\.\d+\.\d+|version\s+\d|eclipse\s+\d|build\s+\d",
    "has_code_ref": r"org\.eclipse\.|java\.|javax\.",
}

# Words behind the lexical flags.
CRASH_WORDS = ["crash", "assertion", "abort", "segfault", "sigsegv"]
ERROR_WORDS = ["error", "exception", "fail", "broken", "failure"]
REGRESSION_WORDS = ["regression", "regress", "regressed"]

# Keyword categories in matching order.
KEYWORD_CATEGORIES = {
    "memory": ["memory", "leak", "oom", "allocation", "heap", "gc", "garbage"],
    "graphics": ["graphics", "render", "webrender", "gpu", "canvas", "layout", "paint"],
    "network": ["network", "http", "fetch", "socket", "request", "response", "cache"],
    "javascript": ["javascript", "js", "wasm", "jit", "script", "async", "promise"],
    "dom": ["dom", "element", "node", "event", "document", "html", "css"],
    "media": ["media", "video", "audio", "codec", "webrtc", "streaming"],
    "security": ["security", "sandbox", "permission", "csp", "certificate", "ssl"],
    "startup": ["startup", "init", "boot", "launch", "cold", "warm"],
    "io": ["io", "disk", "file", "storage", "indexeddb", "localstorage"],
}


def lookup(c: Column, values: dict, default) -> Column:
    """Constant mapping with a default."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def is_noise(resolution: Column, kind: str) -> Column:
    return F.upper(F.coalesce(resolution, F.lit(""))).isin(NOISE_RESOLUTIONS[kind])


def merge_codes(c: Column, merge: dict[int, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in merge.items() for x in kv]), c), c)


def severity_level(c: Column) -> Column:
    return lookup(F.lower(F.coalesce(c, F.lit("normal"))), SEVERITY, 2)


def priority_level(c: Column) -> Column:
    return lookup(F.coalesce(c, F.lit("P3")), PRIORITY, 2)


def build_text(summary: Column, description: Column, max_chars: int | None = None) -> Column:
    """summary [SEP] description; a model's input limit may be given as ``max_chars``."""
    d = F.coalesce(description, F.lit(""))
    return F.concat(F.coalesce(summary, F.lit("")), F.lit(SEP), d if max_chars is None else F.substring(d, 1, max_chars))


def side(text: Column, i: int) -> Column:
    """Summary (0) or description (1) of a built text."""
    return F.coalesce(F.get(F.split(text, r" \[SEP\] "), F.lit(i)), F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def text_features(text: Column) -> dict[str, Column]:
    s, d = side(text, 0), side(text, 1)
    return {
        "summary_length": F.length(s),
        "summary_word_count": F.size(words(s)),
        "desc_length": F.length(d),
        "desc_word_count": F.size(words(d)),
        "has_description": (F.length(d) > 10).cast("int"),
    }


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour, day of week (Monday 0) and month, with defaults for missing dates."""
    return {
        "open_hour": F.coalesce(F.hour(ts), F.lit(12)),
        "open_dayofweek": F.coalesce(F.weekday(ts), F.lit(0)),
        "open_month": F.coalesce(F.month(ts), F.lit(1)),
    }


def clean_text(text: Column) -> Column:
    """Lower case without URLs, everything but a-z and digits as single blanks."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"http\S+|www\S+", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def quality_flags(desc: Column) -> dict[str, Column]:
    out = {n: desc.rlike("(?i)" + p).cast("int") for n, p in QUALITY_PATTERNS.items()}
    out["is_long"] = (F.length(desc) > 200).cast("int")
    score = None
    for c in list(out.values()):
        score = c if score is None else score + c
    out["quality_score"] = score
    return out


def lexical_flags(summary: Column) -> dict[str, Column]:
    """Word flags of a summary. Words are lower-cased first, so ``n_uppercase`` is always 0."""
    low = words(F.lower(summary))

    def has(ws: list[str]) -> Column:
        return F.arrays_overlap(low, F.array(*[F.lit(w) for w in ws])).cast("int")

    return {
        "word_count": F.size(low),
        "char_count": F.length(summary),
        "has_crash": has(CRASH_WORDS),
        "has_error": has(ERROR_WORDS),
        "has_regression": has(REGRESSION_WORDS),
        "has_api_ref": (summary.contains("::") | summary.rlike(r"\w+\.\w+\(")).cast("int"),
        "has_file_path": (summary.contains("/") | summary.contains(".cpp") | summary.contains(".js") | summary.contains(".h")).cast("int"),
        "n_uppercase": F.lit(0),
        "starts_bracket": (summary.startswith("[") | summary.startswith("(")).cast("int"),
    }


def keyword_category(text: Column, categories: dict[str, list[str]] = KEYWORD_CATEGORIES) -> Column:
    """Category with most keyword hits; the first on ties, other without hits, unknown for null."""
    low = F.lower(text)
    ranked = [F.struct(F.lit(0).alias("hits"), F.lit(0).alias("order"), F.lit("other").alias("name"))]
    for i, (name, kws) in enumerate(categories.items()):
        total = None
        for k in kws:
            h = low.contains(k.lower()).cast("int")
            total = h if total is None else total + h
        ranked.append(F.struct(total.alias("hits"), F.lit(-1 - i).alias("order"), F.lit(name).alias("name")))
    return F.when(text.isNull(), "unknown").otherwise(F.array_max(F.array(*ranked))["name"])


def change_magnitudes(new: Column, prev: Column, t: Column | None = None) -> dict[str, Column]:
    """Direction-free sizes of a change."""
    ratio = new / (prev + F.lit(1e-10))
    out = {
        "magnitude_abs": F.abs(new - prev),
        "magnitude_pct_abs": F.abs(F.try_divide((new - prev) * 100.0, prev)),
        "value_mean": (new + prev) / 2.0,
        "value_ratio_abs": F.abs(F.ln(F.least(F.greatest(ratio, F.lit(0.01)), F.lit(100.0)))),
    }
    if t is not None:
        out["t_value_abs"] = F.abs(t)
    return out


def expected_regression(new: Column, prev: Column, lower_is_better: Column) -> Column:
    """The rule behind the regression flag: worse means higher only where lower is better."""
    return F.when(lower_is_better, new > prev).otherwise(~(new > prev))


def alert_targets(status: Column, bug: Column) -> dict[str, Column]:
    s = F.coalesce(status, F.lit(-1))
    return {
        "has_bug": bug.isNotNull().cast("int"),
        "is_valid": s.isin(1, 2, 4).cast("int"),
        "is_invalid": (s == 3).cast("int"),
    }


# --- answers of an external classifier ----------------------------------------------------------


def match_label(df: DataFrame, answer: Column, labels: Sequence[str], name: str = "label") -> DataFrame:
    """Add the label an answer names: exact, then ignoring case, then either contains the other.

    The cleaned answer is a column of its own, so that it is built once and not once per label.
    """
    names = F.array(*[F.lit(x) for x in labels])
    df = df.withColumn("_a", F.trim(F.regexp_replace(F.trim(answer), "^[\"']+|[\"']+$", ""))).withColumn("_low", F.lower("_a"))
    a, low = F.col("_a"), F.col("_low")
    exact = F.get(F.filter(names, lambda n: n == a), F.lit(0))
    folded = F.get(F.filter(names, lambda n: F.lower(n) == low), F.lit(0))
    part = F.get(F.filter(names, lambda n: F.lower(n).contains(low) | low.contains(F.lower(n))), F.lit(0))
    return df.withColumn(name, F.coalesce(exact, folded, part)).drop("_a", "_low")


def json_label(df: DataFrame, answer: Column, labels: Sequence[str], field: str = "class", name: str = "label") -> DataFrame:
    """Add the class in the first JSON object, else the first label named in the text, else the first label."""
    names = F.array(*[F.lit(x) for x in labels])
    df = df.withColumns({"_got": F.trim(F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*\}", 0), f"$.{field}")), "_low": F.lower(answer)})
    got, low = F.col("_got"), F.col("_low")
    exact = F.get(F.filter(names, lambda n: n == got), F.lit(0))
    folded = F.get(F.filter(names, lambda n: F.lower(n) == F.lower(got)), F.lit(0))
    named = F.get(F.filter(names, lambda n: low.contains(F.lower(n))), F.lit(0))
    return df.withColumn(name, F.coalesce(exact, folded, named, F.lit(labels[0]))).drop("_got", "_low")


def prompt(title: Column, description: Column, product: Column, severity: Column, max_chars: int | None = None) -> Column:
    """The question put to an external classifier, one text per ticket."""
    d = description
    if max_chars is not None:
        d = F.when(F.length(d) > max_chars, F.concat(F.substring(d, 1, max_chars), F.lit("..."))).otherwise(d)
    return F.concat(
        F.lit("Title: "),
        title,
        F.when(F.length(description) > 0, F.concat(F.lit("\nDescription: "), d)).otherwise(F.lit("")),
        F.lit("\nProduct: "),
        F.coalesce(product, F.lit("unknown")),
        F.lit("\nSeverity: "),
        F.coalesce(severity, F.lit("normal")),
    )
