"""Text functions as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rules

#: White space as Unicode strips it, for Java regular expressions.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
CJK, KANA = "[\\u4e00-\\u9fff]", "[\\u3040-\\u309f\\u30a0-\\u30ff]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(words: list[str]) -> str:
    """An alternation of literal words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def truncated(x: Column | str, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters, with a mark where some are missing."""
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


# -- language, cleaning, tokens ---------------------------------------------------------------------------------------


def script_language(x: Column | str) -> Column:
    """zh, ja, en by shares of scripts; unknown under ten characters."""
    x = F.coalesce(_c(x), F.lit(""))
    n = F.length(x)
    return (
        F.when(F.length(strip(x)) < 10, "unknown")
        .when(F.regexp_count(x, F.lit(CJK)) / n > 0.3, "zh")
        .when(F.regexp_count(x, F.lit(KANA)) / n > 0.2, "ja")
        .otherwise("en")
    )


def clean(x: Column | str) -> Column:
    """Control characters, running heads, chapter lines, ISBNs, copyright notes and URLs removed; blank lines folded."""
    return strip(reduce(lambda c, s: F.regexp_replace(c, *s), rules.CLEANING, F.coalesce(_c(x), F.lit(""))))


def tokens(x: Column | str) -> Column:
    """Distinct search tokens: words of two or more ASCII characters without stop words; characters and bigrams of Han runs."""
    x = F.coalesce(_c(x), F.lit(""))
    words = F.filter(F.transform(F.regexp_extract_all(x, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), F.lower), lambda w: ~w.isin(rules.STOPWORDS))
    runs = F.regexp_extract_all(x, F.lit(f"{CJK}+"), F.lit(0))
    single = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(words, pairs, F.filter(single, lambda s: s != "")))


def token_estimate(x: Column | str) -> Column:
    """Model tokens by script: 1.5 for a Han character, a quarter for any other."""
    x = F.coalesce(_c(x), F.lit(""))
    han = F.regexp_count(x, F.lit(CJK))
    return (han * 1.5 + (F.length(x) - han) * 0.25).cast("int")


def has_han(x: Column | str) -> Column:
    return _c(x).rlike(CJK)


# -- predicates -------------------------------------------------------------------------------------------------------


def is_placeholder(x: Column | str) -> Column:
    """Empty, or with a placeholder keyword."""
    x = F.coalesce(_c(x), F.lit(""))
    return (x == "") | x.rlike(quoted(rules.PLACEHOLDERS))


def has_placeholder(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(quoted(rules.PLACEHOLDERS))


def is_template(x: Column | str) -> Column:
    """With a template phrase; empty texts are none."""
    return F.coalesce(_c(x), F.lit("")).rlike(quoted(rules.TEMPLATES))


def is_placeholder_or_template(x: Column | str) -> Column:
    return is_placeholder(x) | is_template(x)


def has_substance(x: Column | str, least: int = 20) -> Column:
    return F.coalesce(F.length(strip(x)) >= least, F.lit(False))


def is_merged(x: Column | str) -> Column:
    """A number or title that stands for several chapters."""
    return F.coalesce(_c(x), F.lit("")).rlike("|".join(rules.MERGED))


def has_logic_form(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(rules.LOGIC)


def has_all_logic_parts(x: Column | str) -> Column:
    x = F.coalesce(_c(x), F.lit(""))
    return x.contains("前提假设") & x.contains("推理链条") & x.contains("核心结论")


def chapter_placeholder(number: Column, title: Column, argument: Column) -> Column:
    """(keyword, field) of the first placeholder keyword that a chapter has, else null."""
    out = None
    for kw in rules.CHAPTER_PLACEHOLDERS:
        hit = number.contains(kw) | title.contains(kw) | argument.contains(kw)
        field = F.when(number.contains(kw), "chapter_number").when(title.contains(kw), "title").otherwise("core_argument")
        value = F.struct(F.lit(kw).alias("keyword"), field.alias("field"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_quota_error(message: Column | str) -> Column:
    """A message of an exhausted quota or a rate limit."""
    return F.lower(F.coalesce(_c(message), F.lit(""))).rlike(quoted(rules.QUOTA))


def retry_after(message: Column | str, attempt: Column | int = 0, base: float = 5.0, most: int = 300) -> Column:
    """Seconds that a message asks to wait, else exponential back-off, at most ``most``."""
    m = F.lower(F.coalesce(_c(message), F.lit("")))
    said = F.coalesce(F.nullif(F.regexp_extract(m, r"retry.?after[:\s]+(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(m, r"wait[:\s]+(\d+)", 1), F.lit("")))
    grown = F.lit(base) * F.pow(F.lit(2.0), F.lit(attempt) if isinstance(attempt, int) else attempt)
    return F.least(F.coalesce(said.cast("double"), grown), F.lit(float(most))).cast("int")


def retry_wait(attempt: Column | str, base: float, multiplier: float, most: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), _c(attempt)), F.lit(most)).cast("int")


# -- names, ids, forms ------------------------------------------------------------------------------------------------


def file_format(path: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(_c(path), r"\.[^./\\]+$", 0))
    return F.when(suffix == ".epub", "epub").when(suffix == ".pdf", "pdf").when(suffix.isin(".mobi", ".azw", ".azw3"), "mobi").otherwise("unknown")


def is_supported(path: Column | str) -> Column:
    return file_format(path) != "unknown"


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"[^/\\]+$", 0), r"(?<=.)\.[^.]+$", "")


def title_author(path: Column | str) -> Column:
    """(title, author) from a file name cut at hyphens or underscores."""
    name = stem(path)
    parts = F.split(name, "[-_]")
    two = F.size(parts) >= 2
    return F.struct(F.when(two, strip(parts[0])).otherwise(name).alias("title"), F.when(two, strip(parts[1])).otherwise("Unknown").alias("author"))


def safe_name(x: Column | str, most: int = 100) -> Column:
    """A file name without separators and control characters, of at most ``most`` characters."""
    return F.substring(F.regexp_replace(F.coalesce(_c(x), F.lit("untitled")), "[\\\\/:*?\"<>|\\x00-\\x1f]", "_"), 1, most)


def safe_name_hashed(x: Column | str, most_bytes: int = 180) -> Column:
    """A file name with a hash suffix, within a number of UTF-8 bytes (characters are dropped whole)."""
    x = F.regexp_replace(F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("untitled")), "[\\\\/:*?\"<>|\\x00-\\x1f]", "_")
    safe = F.coalesce(F.nullif(F.regexp_replace(x, "^[ ._]+|[ ._]+$", ""), F.lit("")), F.lit("untitled"))
    budget = most_bytes - 9
    sizes = F.transform(F.filter(F.split(safe, ""), lambda c: c != ""), F.octet_length)
    fitting = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")),
        lambda a, s: F.when((a["used"] + s <= budget) & (a["used"] >= 0), F.struct((a["used"] + s).alias("used"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(-1).alias("used"), a["n"].alias("n"))),
        lambda a: a["n"],
    )
    cut = F.when(F.octet_length(safe) > budget, F.coalesce(F.nullif(F.regexp_replace(F.substring(safe, F.lit(1), fitting), "^[ ._]+|[ ._]+$", ""), F.lit("")), F.lit("untitled"))).otherwise(safe)
    return F.concat(cut, F.lit("_"), F.left(F.sha1(safe), F.lit(8)))


def content_id(x: Column | str, prefix: str = "", n: int | None = None) -> Column:
    """A prefixed md5 of a text, cut to ``n`` digits."""
    h = F.md5(F.coalesce(_c(x), F.lit("")))
    return F.concat(F.lit(prefix), F.left(h, F.lit(n)) if n else h)


def normal_name(x: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Stripped, upper-cased and put through the aliases."""
    name = F.upper(strip(F.coalesce(_c(x), F.lit(""))))
    if not aliases:
        return name
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(table[name], name)


def character_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the two texts' sets of characters; 0 where one is empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(_c(v), F.lit("")), ""), lambda c: c != "")) for v in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def logic_parts(x: Column | str) -> Column:
    """The three parts of a logic statement, null where it has another form."""
    pattern = "前提假设：(.+?)\\s*→\\s*推理链条：(.+?)\\s*→\\s*核心结论：(.+)"
    x = F.coalesce(_c(x), F.lit(""))
    return F.when(x.rlike(pattern), F.struct(*(F.regexp_extract(x, pattern, i + 1).alias(n) for i, n in enumerate(("premise", "chain", "conclusion")))))


def author_of(background: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_c(background), F.lit("")), "作者([^（]+?)(?:（[^）]*）)?[是为]", 1), F.lit(""))


def book_type(x: Column | str) -> Column:
    """The kind with most keywords present, earlier kinds first; other under two."""
    x = F.lower(F.coalesce(_c(x), F.lit("")))
    counts = {k: sum((x.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in rules.BOOK_TYPES.items()}
    most = F.greatest(*counts.values())
    out = F.when(most < 2, "other")
    for k, n in counts.items():
        out = out.when(n == most, k)
    return out


def size_class(n: Column | str) -> Column:
    out = None
    for name, below in rules.SIZE_CLASSES[:-1]:
        out = F.when(_c(n) < below, name) if out is None else out.when(_c(n) < below, name)
    return out.otherwise(rules.SIZE_CLASSES[-1][0])


def wiki_extract(x: Column | str, most: int = 500) -> Column:
    return truncated(strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), f"{SPACE}+", " ")), most)


def chapter_title_like(x: Column | str, size: Column | float = 0.0, bold: Column | bool = False) -> Column:
    """Whether a line is a chapter title: by its wording, or set large and bold."""
    x = strip(F.coalesce(_c(x), F.lit("")))
    size, bold = (v if isinstance(v, Column) else F.lit(v) for v in (size, bold))
    worded = x.rlike("^第[一二三四五六七八九十百零〇\\d]+[章节回篇部卷]|^(?i:chapter)\\s+\\d+|^(?i:part)\\s+\\d+|^\\d+\\.\\s+\\S|^[一二三四五六七八九十]+、|^(序言|前言|引言|绪论|结语|后记|附录|目录)")
    return worded | ((size >= 16) & bold) | ((size >= 14) & bold & (F.length(x) < 50))


def clean_title(x: Column | str) -> Column:
    """Without a page mark or page number at the end."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\\s*·?\\s*第\\s*\\d+\\s*页\\s*$", ""), "\\s+\\d+\\s*$", ""))


def ocr_fixed(x: Column | str, between_digits: bool = True) -> Column:
    """O, l and I read as digits: between digits only, or everywhere."""
    out = F.coalesce(_c(x), F.lit(""))
    for letters, digit in (("O", "0"), ("lI", "1")):
        out = F.regexp_replace(out, f"(?<=\\d)[{letters}](?=\\d)" if between_digits else f"[{letters}]", digit)
    return out


def markdown_cell(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\\|", "｜"), "\\r?\\n", " ")


def mermaid_label(x: Column | str, most: int = 30) -> Column:
    """A mind-map label: brackets, quotes and marks that Mermaid reads are replaced, long ones cut."""
    x = F.translate(F.coalesce(_c(x), F.lit("")), "()[]{}\"'#;|", "（）【】｛｝＂＇＃；｜")
    return truncated(strip(F.regexp_replace(x, "\\s+", " ")), most)


def source_link(title: Column | str, start: Column, end: Column) -> Column:
    return F.format_string("[%s](#L%d-%d)", _c(title), start, end)


def close_braces(x: Column | str) -> Column:
    """As many closing braces added as are missing by count."""
    x = F.coalesce(_c(x), F.lit(""))
    lacking = F.regexp_count(x, F.lit("\\{")) - F.regexp_count(x, F.lit("\\}"))
    return F.concat(x, F.repeat(F.lit("}"), F.greatest(lacking, F.lit(0))))


def has_forbidden(x: Column | str, words: list[str]) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(quoted(words)) if words else F.lit(False)


def feedback_lines(x: Column | str, most: int = 12) -> Column:
    """The first lines that report a failure or a warning, newline-joined."""
    lines = F.filter(F.split(F.coalesce(_c(x), F.lit("")), "\n"), lambda s: s.startswith("- ❌") | s.startswith("- ⚠️"))
    return F.array_join(F.slice(lines, 1, most), "\n")


def expired(at: Column | str, as_of: Column, days: int) -> Column:
    """Whether something of time ``at`` is older than ``days`` at ``as_of``."""
    return as_of > _c(at) + F.make_dt_interval(F.lit(days))


def clean_hints(items: Column | str, most: int, width: int = 80) -> Column:
    """Distinct stripped hints, the first ``most``, each cut to ``width`` characters after the distinction."""
    stripped = F.filter(F.transform(_c(items), strip), lambda s: s != "")
    return F.transform(F.slice(F.array_distinct(stripped), 1, most), lambda s: F.substring(s, 1, width))
