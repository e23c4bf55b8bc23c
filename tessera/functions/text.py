"""Column -> Column text functions (no I/O, all JVM-side expressions).

Everything here is a built-in Spark expression or higher-order function, so it
stays inside whole-stage codegen / the interpreted HOF path and never ships rows
to Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop-word list the quality features count against
# (the public NLTK English list, in its published order).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Regex rules (Java dialect; the DuckDB oracle uses the same patterns).
WORD_TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
SENTENCE_END = r"([.!?])\s+"
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
HEADING_LINE = r"^\s*(#+ \s*\S|<h\d>)"
HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HTML_MARK = r"(?i)<html[\s>]"
SEP = "\u0001"
# What Python's str.split and str.strip take as white space (a regular expression class).
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


# F1
def content_hash(c) -> Column:
    return F.md5(_c(c))


# F2
def call_key(name, params_map) -> Column:
    """``name:md5(json(params with sorted keys))`` (compact JSON, see D23)."""
    canon = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(params_map)))))
    return F.concat(_c(name), F.lit(":"), F.md5(canon))


# F13
def ws_tokens(c) -> Column:
    """Python ``str.split()`` with no argument: runs of whitespace, no empty tokens."""
    return F.filter(F.split(_c(c), f"[{SPACE}]+"), lambda t: t != "")


# F10
def word_tokens(c) -> Column:
    """Word tokens: letter/digit runs, or single punctuation characters."""
    return F.regexp_extract_all(_c(c), F.lit(WORD_TOKEN), 1)


# F11
def stop_word_ratio(words) -> Column:
    stop = F.array(*[F.lit(w) for w in ENGLISH_STOP_WORDS])
    n_stop = F.size(F.filter(_c(words), lambda w: F.array_contains(stop, F.lower(w))))
    return F.try_divide(n_stop.cast("double"), F.size(_c(words)).cast("double"))


# F12 / X4
def repetition_score(words) -> Column:
    w = _c(words)
    return F.lit(1.0) - F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w).cast("double"))


# F4
def is_structured(c) -> Column:
    t = _c(c)
    return t.contains("# ") | t.contains("## ") | t.contains("<h1>") | t.contains("<div")


# F5
def structural_chunks(c) -> Column:
    """Split at heading lines; lines before the first heading form their own chunk."""
    lines = F.split(_c(c), "\n", -1)
    marked = F.transform(
        lines,
        lambda line, i: F.when((i > 0) & line.rlike(HEADING_LINE), F.concat(F.lit(SEP), line)).otherwise(line),
    )
    return F.split(F.array_join(marked, "\n"), "\n" + SEP, -1)


# F6
def sentences(c) -> Column:
    """Sentence split after ``. ! ?`` followed by whitespace; trimmed, empty ones dropped."""
    parts = F.split(F.regexp_replace(_c(c), SENTENCE_END, "$1" + SEP), SEP, -1)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


# F7
def chunk_starts(sents, max_length: int = 1000) -> Column:
    """Greedy packing: 1-based index of the first sentence of each chunk.

    A sentence that would push the running length over ``max_length`` starts a
    new chunk; an oversized sentence stays whole (and never leaves an empty
    chunk behind, D25).  The fold appends once per chunk, not per sentence.
    """
    s = _c(sents)
    init = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("len"), F.lit(0).alias("i"))

    def step(acc, sent):
        n = F.length(sent)
        i = acc["i"] + 1
        new_chunk = (F.size(acc["starts"]) == 0) | (acc["len"] + n > max_length)
        return F.struct(
            F.when(new_chunk, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
            F.when(new_chunk, n).otherwise(acc["len"] + n).alias("len"),
            i.alias("i"),
        )

    return F.aggregate(s, init, step)["starts"]


def slice_chunks(sents, starts, sep: str = " ") -> Column:
    """Chunk texts from sentence array and chunk start indexes (both should be plain column references)."""
    s, st = _c(sents), _c(starts)
    bounds = F.concat(st, F.array(F.size(s) + 1))
    return F.transform(st, lambda b, k: F.array_join(F.slice(s, b, F.element_at(bounds, k + 2) - b), sep))


def pack_sentences(sents, max_length: int = 1000) -> Column:
    """Single-expression form of F7 (for small inputs; ``chunk_documents`` materialises the steps)."""
    return slice_chunks(sents, chunk_starts(sents, max_length))


# F8
def hybrid_chunks(c, max_length: int = 1000) -> Column:
    return F.when(is_structured(c), structural_chunks(c)).otherwise(pack_sentences(sentences(c), max_length))


# F9
def first_title_line(c) -> Column:
    cands = F.filter(F.transform(F.split(_c(c), "\n", -1), strip), lambda l: (F.length(l) > 0) & (F.length(l) < 100))
    return F.try_element_at(cands, F.lit(1))


def decode_basic_entities(c) -> Column:
    out = _c(c)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


# F9b
def has_html_title(c) -> Column:
    t = _c(c)
    return t.rlike(HTML_MARK) & t.rlike(r"(?is)<title[^>]*>.*?</title>")


def html_title(c) -> Column:
    """Text of the first ``<title>`` element, basic entities decoded; null when empty."""
    raw = F.regexp_extract(_c(c), HTML_TITLE, 1)
    return F.when(raw != "", decode_basic_entities(raw))


def title(c) -> Column:
    """HTML pages: the ``<title>`` text (null if empty); otherwise the first short non-blank line."""
    return F.when(has_html_title(c), html_title(c)).otherwise(first_title_line(c))


# F9c
def iso_dates(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(ISO_DATE), 1)


# F14
def length_feature(c) -> Column:
    return F.length(_c(c)) / F.lit(1000.0)


# F15
def freshness(age_days, half_life_days: float = 30.0, default: float = 0.8) -> Column:
    return F.coalesce(F.exp(-_c(age_days) / F.lit(half_life_days) * F.log(F.lit(2.0))), F.lit(default))


# F16
def special_char_count(c) -> Column:
    return F.length(F.regexp_replace(_c(c), r"[\p{L}\p{N}]", ""))


# X2
def term_overlap(q_tokens, d_tokens) -> Column:
    q = F.array_distinct(_c(q_tokens))
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(q, _c(d_tokens))).cast("double"), F.size(q).cast("double")),
        F.lit(0.0),
    )


# F18
def dot(a, b) -> Column:
    """Inner product in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


# G11
def vector_mean(a) -> Column:
    return F.try_divide(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(_c(a)).cast("double"))


# F19
def markdown_row(*cols) -> Column:
    return F.concat_ws(" | ", *[_c(x).cast("string") for x in cols])


# F22
def parse_time_range(text: str) -> str:
    """``7d`` -> ``INTERVAL 7 DAYS`` (driver-side parse of a parameter, not of data)."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([mhdw])\s*", text)
    if not m:
        raise ValueError(f"bad time range {text!r}; expected <n>[mhdw]")
    n, unit = int(m.group(1)), m.group(2)
    if unit == "w":
        n, unit = n * 7, "d"
    return f"INTERVAL {n} " + {"m": "MINUTES", "h": "HOURS", "d": "DAYS"}[unit]
