"""Model output as VARIANT: damaged JSON mended by expressions, and documents of any make brought into one declared shape.

Everything here is a Column expression, so it runs inside the scan's stage: no shuffle, no Python. Values that are used more
than once are bound by :func:`once`: Spark does not share what is repeated inside lambdas.

Defined cases: null and empty texts, and texts without a JSON object, have no document and the status ``none``; the shape of
no document is its defaults. A field of JSON null is as good as absent. Repeated rows are rows like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.text import SPACE, quoted

#: A whole string of a JSON text: strings are passed over, so that what they hold is left alone.
_STRING = r'"(?:[^"\\]++|\\.)*+"'


#: Comments and bold marks of keys, commas before a closing bracket.
_PLAIN, _TRAILING = r"//[^\n]*|/\*.*?\*/|\*\*(?=\s*[\"\[{:\d])", r",(?=\s*[}\]])"


def _outside(x: Column, pattern: str, there: Column) -> Column:
    """Without the matches of ``pattern`` outside strings; a string that is still open goes to the end. Strings are looked at only
    if ``there``, which is true of any bound text ``x`` with a match."""
    return F.when(there, F.regexp_replace(x, f"(?s)({_STRING}?+)|{pattern}", "$1")).otherwise(x)


def _without_marks(x: Column) -> Column:
    return _outside(x, _PLAIN, x.contains("//") | x.contains("/*") | x.contains("**"))


def _without_trailing(x: Column) -> Column:
    return _outside(x, _TRAILING, x.rlike(_TRAILING))


def _unfinished(x: Column) -> Column:
    """A text cut off somewhere, with its open string and its open brackets closed; ``x`` is bound."""

    def closed(rest: Column) -> Column:
        # an end is looked for only where the last characters have it; there may be a line's end after it
        whole = F.when(F.right(x, F.lit(3)).contains("\\"), F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\$", "$1")).otherwise(x)
        body = F.when(rest.contains('"'), F.concat(whole, F.lit('"'))).otherwise(x)
        body = once(body, lambda b: F.when(F.right(b, F.lit(3)).rlike(r"[\s,]"), F.regexp_replace(b, r"[\s,]+$", "")).otherwise(b))
        brackets = F.regexp_extract_all(F.regexp_replace(rest, r'(?s)".*', ""), F.lit(r"[{}\[\]]"), F.lit(0))
        closing = F.aggregate(brackets, F.lit(""), lambda s, b: F.when(b == "{", F.concat(F.lit("}"), s)).when(b == "[", F.concat(F.lit("]"), s)).otherwise(F.substring(s, 2, 2**31 - 1)))
        return F.concat(body, closing)

    return once(F.regexp_replace(x, f"(?s){_STRING}", ""), closed)


def _object(x: Column) -> Column:
    """The VARIANT of a text that is a JSON object, else null."""
    return F.try_parse_json(F.when(x.rlike(r"^\s*\{"), x))


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def _attempt(how: str, x: Column) -> Column:
    """(status, document) of a text that is a JSON object, worked out once; else null."""
    return once(x, lambda t: once(_object(t), lambda v: F.when(v.isNotNull(), F.struct(F.lit(how).alias("status"), v.alias("document")))))


def document(x: Column | str) -> Column:
    """(status, document) of a model's output.

    ``parsed``: a JSON object as it is. ``extracted``: the text from the first brace to the last, without fences and prose.
    ``mended``: that, without comments, trailing commas and bold marks of keys. ``closed``: from the first brace on, the open
    string and brackets closed. ``cut``: the same, without a last member that has no whole value. Each is tried if none before
    gave a document.
    """
    none = F.struct(F.lit("none").alias("status"), F.lit(None).cast("variant").alias("document"))

    def within(x: Column, inner: Column) -> Column:
        # a text that was tried already is not parsed again
        mended = once(once(_without_marks(inner), _without_trailing), lambda m: F.when(m != inner, _attempt("mended", m)))
        return F.coalesce(F.when(inner != x, _attempt("extracted", inner)), mended)

    def begun(opened: Column) -> Column:
        cut = F.regexp_replace(opened, r'(?s)(?:,\s*|(?<=\{)\s*)"(?:[^"\\]|\\.){0,200}(?:"\s*:?\s*[^",\[\]{}]*)?$', "")
        return F.coalesce(*(_attempt(how, once(once(t, _unfinished), _without_trailing)) for how, t in (("closed", opened), ("cut", cut))))

    def tried(x: Column) -> Column:
        opened = once(F.regexp_extract(x, r"(?s)\{.*", 0), lambda o: F.when(o.contains("```"), F.regexp_replace(o, r"\s*```\s*$", "")).otherwise(o))
        return F.coalesce(_attempt("parsed", x), once(F.regexp_extract(x, r"(?s)\{.*\}", 0), lambda inner: within(x, inner)), once(once(opened, _without_marks), begun), none)

    return once(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), tried)


@dataclass(frozen=True)
class Text:
    """A text. Of a list, its first entry where ``first`` says so; other values as their JSON; ``default`` if absent."""

    default: str = ""
    first: bool = False


@dataclass(frozen=True)
class Texts:
    """A list of texts. A text alone is cut at ``split`` and blank parts go; without ``split`` it is the only entry."""

    split: str | None = None


@dataclass(frozen=True)
class Mapping:
    """Texts by name. A text alone gets the name ``text_as``."""

    text_as: str = "text"


@dataclass(frozen=True)
class Record:
    """An object of given fields. A text alone fills the fields of ``text_as``; others have their defaults."""

    fields: dict = field(default_factory=dict)
    text_as: tuple[str, ...] = ()


@dataclass(frozen=True)
class Records:
    """A list of objects. Texts in it fill ``text_as``; entries that are neither go, and so do placeholders; a text or object alone is one entry if ``lone``."""

    fields: dict = field(default_factory=dict)
    text_as: tuple[str, ...] = ()
    lone: bool = False


#: A placeholder text: one of the words, in brackets too, or one of them with fewer than ten characters after it.
PLACEHOLDER = f"(?s)^{SPACE}*(?:(?:{quoted(rules.OUTPUT_PLACEHOLDERS)}).{{0,9}}|（(?:{quoted(rules.OUTPUT_PLACEHOLDERS)})）){SPACE}*$"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID or the name of another type; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def at(v: Column, name: str) -> Column:
    """The value of a field; null where there is none."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _readable(v: Column, instead: Column) -> Column:
    """The text of a value, ``instead`` of a placeholder; null of JSON null. What kind it is of is asked of texts that read as one only."""
    return once(_string(v), lambda t: F.when(t.rlike(PLACEHOLDER) & (kind(v) == "STRING"), instead).otherwise(t))


def _cleaned(v: Column) -> Column:
    return _readable(v, F.lit(""))


def _list(v: Column) -> Column:
    """The entries of a list; null of other values."""
    return F.try_variant_get(v, "$", "array<variant>")


#: A text of common characters among which is no white space.
_UNSPACED = r"^[!-~\xa1-\u167f\u3001-\ud7ff]*+\z"


def _split(t: Column, mark: str) -> Column:
    """The parts of a text between marks, without white space around them and without blank ones."""
    parts = F.split(t, mark, -1)
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, f"^{SPACE}+|{SPACE}+$", ""))
    return F.array_remove(F.when(t.rlike(_UNSPACED), parts).otherwise(trimmed), "")


def _records(items: Column, shape: Records) -> Column:
    """The entries that are objects or texts, placeholders not among them, in the shape of a record."""
    kinds, none = f"struct<{','.join(f'`{n}`:variant' for n in shape.fields)}>", F.lit(None).cast("string")

    def record(members: Column, text: Column) -> Column:
        parts = []
        for name, inner in shape.fields.items():
            value = shaped(members[name], inner)
            parts.append((F.coalesce(text, value) if name in shape.text_as else value).alias(name))
        return F.struct(*parts)

    def entry(x: Column) -> Column:
        # an object has members, however few it has of the fields; a text has none
        def read(o: Column) -> Column:
            text = F.when(kind(x) == "STRING", _readable(x, none))
            return F.when(o.isNotNull(), record(o, none)).otherwise(once(text, lambda t: F.when(t.isNotNull(), record(F.lit(None).cast(kinds), t))))

        return once(F.try_variant_get(x, "$", kinds), read)

    return F.filter(F.transform(items, entry), lambda r: r.isNotNull())


def shaped(v: Column, shape) -> Column:
    """The value of a VARIANT in a declared shape; of null and of types that do not fit, the shape's defaults."""
    if isinstance(shape, Text):
        if shape.first:
            v = F.when(kind(v) == "ARRAY", F.get(_list(v), 0)).otherwise(v)
        return F.coalesce(_cleaned(v), F.lit(shape.default))
    if isinstance(shape, Texts):
        lone = once(_cleaned(v), lambda t: _split(t, quoted([shape.split]))) if shape.split else F.array(_cleaned(v))
        other = F.when(kind(v) == "STRING", lone).otherwise(F.array().cast("array<string>"))
        listed = F.filter(F.transform(_list(v), lambda x: _readable(x, F.lit(None).cast("string"))), lambda t: t.isNotNull())
        return F.coalesce(listed, other)
    if isinstance(shape, Mapping):
        named = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.coalesce(_cleaned(x), F.lit("")))
        other = F.when(kind(v) == "STRING", F.create_map(F.lit(shape.text_as), _cleaned(v))).otherwise(F.create_map().cast("map<string,string>"))
        return F.coalesce(named, other)
    if isinstance(shape, Record):
        parts = []
        for name, inner in shape.fields.items():
            value = once(at(v, name), lambda x: shaped(x, inner))
            if name in shape.text_as:
                value = F.when(kind(v) == "STRING", _cleaned(v)).otherwise(value)
            parts.append(value.alias(name))
        return F.struct(*parts)
    alone = [F.when(kind(v).isin("STRING", "OBJECT"), F.array(v))] if shape.lone else []
    return _records(F.coalesce(_list(v), *alone, F.array().cast("array<variant>")), shape)


def _texts(*names: str) -> dict:
    return {n: Text() for n in names}


_STAGES = Records(_texts("name", "description"), ("name",), lone=True)

#: The shape of a book's analysis.
BOOK = Record(
    {
        "metadata": Record({"title": Text("Unknown", first=True), "author": Text("Unknown", first=True), "author_intro": Text(), "discipline": Text("哲学")}),
        "time_background": Record(_texts(*rules.TIME_FIELDS)),
        "chapters": Records(_texts("chapter_number", "title", "core_argument", "underlying_logic"), ("title",)),
        "core_concepts": Records({**_texts("name", "definition", "deep_meaning", "underlying_logic", "critical_review"), "core_drivers": Texts("、"), "development_stages": _STAGES}, ("name",)),
        "key_insights": Records({**_texts("title", "description", "underlying_logic", "controversies"), "multi_perspectives": Mapping("其他视角")}, ("title",)),
        "key_cases": Records({**_texts("name", "source_chapter", "event_description", "historical_limitations"), "core_drivers": Texts("、"), "development_stages": _STAGES}, ("name",)),
        "key_quotes": Records(_texts("text", "chapter", "core_theme", "background_context", "underlying_logic"), ("text",)),
        "critical_analysis": Record(
            {
                **_texts("feminist_perspective", "postcolonial_perspective"),
                "core_doubts": Records(_texts("question", "analysis"), ("question",), lone=True),
                "ethical_boundaries": Record(_texts("reasonable", "dangerous", "institutional_safeguards"), ("reasonable",)),
            }
        ),
        "learning_path": Record({s: Texts() for s in rules.LEARNING_STAGES}),
        "book_network": Mapping(),
    }
)


def book(doc: Column) -> Column:
    """A book's analysis in the shape BOOK: fields filled in, types mended, placeholder texts emptied or left out of lists."""
    return shaped(doc, BOOK)
