"""Personal data: spans of fixed kinds, and terms that give protected entities away.

The values found by the base patterns are the protected entities. Over the whole corpus,
the words next to an entity are counted together with it; the pointwise mutual
information of a word and an entity, as a share of the entity's own information, says
how much of the entity the word discloses. Words over the threshold become spans too.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import free_name
from traitloom.scratch import cut

# A match can only begin where a run of its first characters does, or where the match
# before it ended; saying so, and never giving characters back, keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LETTERS = r"\p{L}+"


@dataclass(frozen=True)
class Disclosure:
    """When a term reveals an entity."""

    window: int = 5  # letter words looked at on either side of an entity
    reach: int = 120  # code points in which these words are looked for
    least_texts: int = 3  # different texts in which term and entity stand together
    threshold: float = 0.8  # share of the entity's information that the term gives
    shortest: int = 3  # letters of a term


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x: x.cast("int"))
    doubled = F.transform(
        digits, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    )
    return F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """The items in blocks of the square root of their number.

    Spark's arrays and strings are copied when something is appended and read from their start
    when a place is looked up; by blocks that stays far from the square of their length.
    """
    step = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), step), lambda at: at <= F.size(items))
    return F.transform(starts, lambda at: F.slice(items, at, step))


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of the numbers, what ``merge`` (a sum or the greatest) makes of all up to it, from 0 on."""
    none = F.array().cast("array<int>")

    def along(items: Column, first: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(first.alias("last"), none.alias("all")),
            lambda done, x: F.struct(
                merge(done["last"], x).alias("last"), F.array_append(done["all"], merge(done["last"], x)).alias("all")
            ),
            lambda done: done["all"],
        )

    def by_block(blocks: Column) -> Column:
        last = along(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), merge)), F.lit(0))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0)), last), lambda block, first: F.when(
            block.isNull(), none).otherwise(along(block, first))))

    return _bound(_bound(numbers, _blocks), by_block)


def spans(text: Column, pattern: Column | str) -> Column:
    """All matches, left to right: array of (start, end, value) in code points, end exclusive.

    What lies between the matches gives their places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.struct(
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"),
    )

    def placed(found: Column) -> Column:
        ends = _running(
            F.zip_with(found["gaps"], found["values"], lambda gap, value: gap + F.coalesce(F.length(value), F.lit(0))),
            lambda a, b: a + b,
        )
        each = F.zip_with(found["values"], ends, lambda value, end: F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")
        ))
        return F.filter(each, lambda x: x["value"].isNotNull())

    return _bound(found, placed)


def outside(terms: Column, base: Column) -> Column:
    """The terms that share no place with a base span.

    A term meets one if of the base spans that begin before its end, one ends after its start.
    """
    events = F.array_sort(F.concat(
        F.transform(terms, lambda x: F.struct(
            x["end"].alias("at"), F.lit(0).alias("order"), x["start"].alias("from"), F.lit(0).alias("reach"), x["value"].alias("value"))),
        F.transform(base, lambda x: F.struct(
            x["start"].alias("at"), F.lit(1).alias("order"), x["start"].alias("from"), x["end"].alias("reach"), F.lit("").alias("value"))),
    ))

    def free(events: Column) -> Column:
        reached = _running(F.transform(events, lambda x: x["reach"]), _greater)
        each = F.zip_with(events, reached, lambda x, reach: F.struct(
            x["from"].alias("start"), x["at"].alias("end"), x["value"].alias("value"),
            ((x["order"] == 0) & (reach <= x["from"])).alias("free"),
        ))
        kept = F.filter(each, lambda x: x["free"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    return _bound(events, free)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; texts without its telling character are not searched."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    telling = {
        "email": text.contains("@"), "phone": text.contains("+"),
        "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
    }[kind]
    return F.when(telling, F.filter(spans(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))).otherwise(none)


def each_span(make: Callable[[str, Column], Column], kinds: Iterable[str] = tuple(PATTERNS)) -> Column:
    """``make(kind, span)`` for all spans of these kinds, kind by kind."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: make(kind, x))

    return F.concat(*map(of, kinds))


def _same_form(kind: str, value: Column) -> Column:
    """What two spellings of one value have in common."""
    return {"email": F.lower(value), "ip": value}.get(kind, _digits(value))


def terms_of(text: Column, shortest: int) -> Column:
    """The different lower-case letter words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda x: F.length(x) >= shortest))


def found_entities(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Write, for every document: ``row`` (its columns ``carry``), at (its number), text (null stays null),
    the spans of each kind, and whether there is any."""
    row = F.struct(*[F.col(f"`{name}`") for name in carry])
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(row.alias("row"), F.col("text").cast("string").alias("text")).select(
        "row", F.monotonically_increasing_id().alias("at"), "text", *[base_spans(text, kind).alias(kind) for kind in PATTERNS]
    )
    return cut(marked.withColumn("any", F.greatest(*[F.size(kind) for kind in PATTERNS]) > 0), "entities")[0]


def _cuts(text: Column, reach: int) -> Column:
    """The text in pieces of ``step`` code points, each with ``reach`` more on either side."""

    def cuts(step: Column) -> Column:
        def piece(k: Column) -> Column:
            origin = F.greatest(k * step - reach, F.lit(0))
            return F.substring(text, origin + 1, (k + 1) * step + reach - origin)

        many = F.floor(F.length(text) / step).cast("int")
        return F.struct(step.alias("step"), F.transform(F.sequence(F.lit(0), many), piece).alias("pieces"))

    return _bound(F.greatest(F.lit(4 * reach), F.ceil(F.sqrt(F.length(text))).cast("int")), cuts)


def _part(cuts: Column, reach: int, place: Column, shift: Column, size: Column) -> Column:
    """``size`` code points of the cut text from ``place + shift`` on, none of them over ``reach`` away from ``place``."""
    k = F.floor(place / cuts["step"]).cast("int")
    origin = F.greatest(k * cuts["step"] - reach, F.lit(0))
    return F.substring(F.get(cuts["pieces"], k), place + shift - origin + 1, size)


def entity_terms(found: DataFrame, rule: Disclosure) -> DataFrame:
    """Rows (at, same, entity, term): the words around each entity of each document."""
    text = F.col("text")

    def beside(cuts: Column) -> Column:
        def around(kind: str, x: Column) -> Column:
            before = F.least(x["start"], F.lit(rule.reach))
            return F.struct(
                F.concat(F.lit(f"{kind}:"), _same_form(kind, x["value"])).alias("entity"),
                (x["start"] > rule.reach).alias("cut"),
                _part(cuts, rule.reach, x["start"], -before, before).alias("left"),
                _part(cuts, rule.reach, x["end"], F.lit(0), F.lit(rule.reach)).alias("right"),
            )

        return each_span(around)

    each = found.where("any").select(
        "at", F.xxhash64("text").alias("same"), F.explode(_bound(_cuts(text, rule.reach), beside)).alias("x")
    )
    left, right = F.col("x.left"), F.col("x.right")
    # a word that the reach cuts in two is not looked at
    left = F.when(F.col("x.cut"), F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == rule.reach, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    words = [F.filter(F.split(F.lower(side), r"\P{L}+"), lambda x: x != "") for side in (left, right)]
    near = F.concat(
        F.slice(words[0], F.greatest(F.size(words[0]) - rule.window + 1, F.lit(1)), F.lit(rule.window)),
        F.slice(words[1], F.lit(1), F.lit(rule.window)),
    )
    terms = F.filter(near, lambda x: F.length(x) >= rule.shortest)
    return each.select("at", "same", F.col("x.entity").alias("entity"), F.explode_outer(terms).alias("term")).distinct()


def disclosing_terms(docs: DataFrame, near: DataFrame, rule: Disclosure) -> DataFrame:
    """Rows (entity, term, share): terms that disclose at least ``threshold`` of an entity.

    With p over all documents, share = log(p(t, e) / (p(t) p(e))) / -log(p(e)). An entity
    that all documents hold has no information and is not disclosed.
    """
    total = docs.count()
    # pairs first: only their terms need the number of documents that hold them
    pairs = near.where("term IS NOT NULL").groupBy("entity", "term", "same").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = pairs.where(F.col("texts") >= rule.least_texts)
    entities = (
        near.select("at", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    )
    used = (
        docs.select(F.explode(terms_of(F.col("text").cast("string"), rule.shortest)).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    )
    known = pairs.join(entities, "entity").join(used, "term").where(F.col("n_entity") < total)
    information = F.log(F.lit(total) / F.col("n_entity"))
    mutual = F.log(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    share = known.select("entity", "term", F.round(mutual / information, 9).alias("share"))
    return share.where(F.col("share") >= rule.threshold)


def disclosures(docs: DataFrame, carry: list[str], rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: row (its columns ``carry``), text (a null stays null), and spans by kind.

    Kinds are email, ip, card, phone, and term: all places, in any document, of the words
    that disclose an entity; who names such a word gives the entity away also without it. A
    term that shares a place with a base span is no span of its own. Null texts are empty and have no spans; an
    empty table gives no rows. Rows that repeat are searched each, and count as documents each, but
    texts that are equal count once for ``least_texts``.
    """
    found = found_entities(docs, carry)
    near, _ = cut(entity_terms(found, rule), "near-terms")
    revealing, _ = cut(disclosing_terms(found, near, rule).select("term").distinct(), "disclosing-terms")
    # a document's list holds words of its own only; written, so that Spark knows its size before it moves texts
    words = found.select("at", F.explode(terms_of(F.col("text"), rule.shortest)).alias("term"))
    by_doc, _ = cut(
        words.join(revealing, "term").groupBy("at").agg(F.array_sort(F.collect_set("term")).alias("terms")), "document-terms"
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    terms = outside(spans(F.col("text"), pattern), F.concat(*PATTERNS))
    return found.join(by_doc, "at", "left").select(
        "row", "text", *PATTERNS, F.when(F.size("terms") > 0, terms).otherwise(none).alias("term")
    )


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans of these kinds, comma-joined."""
    return F.array_join(each_span(lambda kind, x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]), kinds), ",")


def sanitised(text: Column) -> Column:
    """``text`` with base spans generalised to their kind and disclosing terms to [TERM].

    Spans that overlap become one, named after the first, of those the longest.
    """
    marks = F.array_sort(each_span(
        lambda kind, x: F.struct(
            x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")
        ),
        (*PATTERNS, "term"),
    ))

    def cleaned(marks: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), _running(F.transform(marks, lambda x: x["end"]), _greater))
        each = F.zip_with(marks, ends, lambda x, before: F.struct(
            before.alias("before"), x["start"].alias("start"), x["mark"].alias("mark")
        ))
        kept = F.filter(each, lambda x: x["start"] >= x["before"])

        def joined(block: Column) -> Column:
            first, last = block[0]["before"], F.element_at(block, -1)["start"]
            return _bound(F.substring(text, first + 1, last - first), lambda part: F.array_join(F.transform(block, lambda x: F.concat(
                F.substring(part, x["before"] - first + 1, x["start"] - x["before"]), x["mark"])), ""))

        made = F.array_join(F.transform(_bound(kept, _blocks), joined), "")
        return F.concat(made, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(marks) > 0, _bound(marks, cleaned)).otherwise(text)


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The same documents with sanitised texts; texts without spans stay as they are, null too."""
    columns = docs.columns
    made = free_name(docs, "made")
    safe = disclosures(docs, [name for name in columns if name != "text"] or columns, rule)
    return safe.select("row.*", sanitised(F.col("text")).alias(made)).select(
        *[F.col(made).alias(name) if name == "text" else F.col(f"`{name}`") for name in columns]
    )
