"""Personal data and the terms that give it away, with DataFrame functions only.

Base entities are e-mail addresses, IP addresses, card and phone numbers. A term (a word of letters)
discloses an entity if knowing the term nearly settles the entity: with counts over the lines of the
whole corpus, the pointwise mutual information of term and entity is set against the information
content of the entity,

    disclosure = log(p(e, t) / (p(e) p(t))) / -log p(e),

which is 1 if the term occurs only in lines with the entity. Terms seen beside the entity in at least
``min_support`` different lines are generalised from ``generalise_at`` and removed from ``remove_at``
on, in every text that names them, with or without the entity; removed if any entity asks for it.

Matches are leftmost and do not overlap within a kind. The patterns below say the same as the plain
ones but never try the inside of a run again, so a long run costs linear time. No match crosses a
line break.

Defined cases: a null text stays null and has no spans; repeated rows get the same result each, and
as lines they count as often as they occur, while support counts different lines; no rows give no
rows; other columns are kept, whatever their names, except one named ``pii_spans``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import materialise
from provspark.operators.sizing import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap conditions that any text with a match meets.
GUARDS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
TERM = r"\p{L}{4,}"
BLOCK = 256
# Texts with terms, counted by term, that are joined by broadcast.
TERM_ROWS = 100_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.reverse(F.split(_digits(text), "(?<=.)(?=.)"))

    def weight(d: Column, i: Column) -> Column:
        d = d.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.char_length(F.ltrim(p, F.lit("0"))) <= 3
        part = lambda p: small(p) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks, so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def within(x: Column, base: Column) -> Column:
        return F.transform(x, lambda _, j: base + total(F.slice(x, F.lit(1), j)))

    def all_blocks(blocks: Column) -> Column:
        return _let(F.transform(blocks, total), lambda sums: F.flatten(
            F.transform(blocks, lambda x, i: _let(total(F.slice(sums, F.lit(1), i)), lambda base: within(x, base)))
        ))

    def cut(values: Column) -> Column:
        last = F.ceil(F.size(values) / BLOCK).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    return _let(lengths, lambda values: _let(cut(values), all_blocks))


def matches(text: Column, kind: str, pattern: str, guard: Column) -> Column:
    """All matches of a pattern as an array of ``(kind, start, end, value)``, in code points.

    The pieces between the matches and the matches themselves give the positions.
    """
    none = F.array().cast(SPANS)

    def spans(hits: Column) -> Column:
        pieces = F.slice(F.split(text, F.lit(pattern), -1), F.lit(1), F.size(hits))
        pairs = F.zip_with(pieces, hits, lambda p, h: F.struct(F.char_length(p).alias("gap"), F.char_length(h).alias("n"), h.alias("value")))

        def placed(pairs: Column) -> Column:
            before = _sums_before(F.transform(pairs, lambda s: (s.gap + s.n).cast("bigint")))
            return F.zip_with(pairs, before, lambda s, at: F.struct(
                F.lit(kind).alias("kind"), (at + s.gap).alias("start"), (at + s.gap + s.n).alias("end"), s.value.alias("value")
            ))

        return F.when(F.size(hits) > 0, _let(pairs, placed)).otherwise(none)

    return F.when(guard, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def with_entities(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the base entities of a text, by kind, then start."""

    def found(kind: str) -> Column:
        guard = F.coalesce(GUARDS[kind](F.col(text)), F.lit(False))
        return F.filter(matches(F.col(text), kind, PATTERNS[kind], guard), lambda s: _valid(kind, s.value))

    return df.withColumn(out, F.concat(*[found(kind) for kind in KINDS]))


def _may_hold(text: Column) -> Column:
    guards = [F.coalesce(GUARDS[kind](text), F.lit(False)) for kind in KINDS]
    return guards[0] | guards[1] | guards[2] | guards[3]


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span.kind, F.lower(span.value))


def disclosing_terms(
    df: DataFrame, text: str = "text", min_support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97
) -> DataFrame:
    """``(entity, term, disclosure, removed)`` for the terms that disclose an entity, from the whole corpus.

    Lines with an entity are counted per different line first, so copies cost one row. The lines of
    every word are counted inside the tasks first, so that what is shuffled and joined is vocabulary.
    """
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    held = with_entities(lines.where(_may_hold(F.col("line"))), "line", "spans").where("size(spans) > 0")
    held = materialise(held.groupBy("line").agg(F.count("*").alias("n")), "entity-lines")
    held = with_entities(held, "line", "spans")
    entities = F.array_distinct(F.transform("spans", _entity))
    rest = F.col("line")
    for kind in KINDS:
        rest = F.regexp_replace(rest, PATTERNS[kind], " ")
    held = held.select("n", entities.alias("entities"), F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(TERM), F.lit(0))).alias("terms"))
    each = held.select("n", F.explode("entities").alias("entity"), "terms")
    by_entity = each.groupBy("entity").agg(F.sum("n").alias("n_e"))
    pairs = each.select("n", "entity", F.explode("terms").alias("term")).groupBy("entity", "term")
    pairs = pairs.agg(F.sum("n").alias("n_et"), F.count("*").alias("support")).where(F.col("support") >= min_support)
    pairs = materialise(pairs.join(by_entity, "entity"), "entity-terms")
    n_lines = lines.count()
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit(False).alias("removed"))
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("term"))
    counted = words.groupBy("term").agg(F.count("*").alias("n_t"))
    information = F.log(F.lit(float(n_lines)) / F.col("n_e"))
    pairs = pairs.join(counted, "term").withColumn("disclosure", F.when(information > 0, (F.log(F.col("n_et") / F.col("n_t")) + information) / information).otherwise(0.0))
    pairs = pairs.where(F.col("disclosure") >= generalise_at)
    return materialise(pairs.select("entity", "term", "disclosure", (F.col("disclosure") >= remove_at).alias("removed")), "disclosure")


def _terms_of_texts(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``(_key, _terms)``: the terms a text names that disclose any entity; texts that name none are left out."""
    terms = materialise(terms.groupBy("term").agg(F.max("removed").alias("removed")), "terms")
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))
    texts = df.select(F.md5(text).alias("_key"), F.explode(named).alias("term")).join(broadcast_if_small(terms), "term")
    texts = texts.groupBy("_key").agg(F.collect_set(F.struct("term", "removed")).alias("_terms"))
    texts = materialise(texts, "text-terms")
    return broadcast_if_small(texts, texts.agg(F.sum(F.size("_terms"))).first()[0] or 0, TERM_ROWS)


def find_private(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """Add ``pii_spans``: the base entities by kind and start, then the spans of disclosing terms."""
    columns = [c for c in df.columns if c != "pii_spans"]
    kept = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)]
    whole = f"in_{columns.index(text)}"
    terms = disclosing_terms(df, text, **limits)
    found = with_entities(df.select(*kept), whole, "pii_spans")
    if not terms.isEmpty():
        texts = _terms_of_texts(df, text, terms)
        found = found.withColumn("_key", F.md5(whole)).join(texts, "_key", "left")
        found = found.withColumn("_words", matches(F.col(whole), "term", TERM, F.col("_terms").isNotNull()))

        def known(kind: str, removed: bool) -> Column:
            is_term = lambda s: F.exists("_terms", lambda t: (t.term == F.lower(s.value)) & (t.removed == removed))
            return F.transform(F.filter("_words", is_term), lambda s: s.withField("kind", F.lit(kind)))

        spans = F.coalesce(F.concat("pii_spans", known("removed", True), known("general", False)), "pii_spans")
        found = found.withColumn("pii_spans", spans)
    return found.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)], "pii_spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*KINDS))


def sanitise(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``df`` with entities replaced by their kind, disclosing terms generalised (``[term]``) or removed.

    Adds ``pii_spans`` with positions in the text as it was. Spans that overlap are replaced as one.
    """
    found = find_private(df, text, **limits)
    columns = found.columns
    kept = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)]
    whole, spans = F.col(f"in_{columns.index(text)}"), f"in_{columns.index('pii_spans')}"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    # The spans that are replaced, each with the end of what was replaced before it.
    start = F.struct(F.array().cast("array<struct<before:bigint,start:bigint,kind:string>>").alias("cuts"), F.lit(0).cast("bigint").alias("at"))

    def step(a: Column, s: Column) -> Column:
        cut = F.array(F.struct(a.at.alias("before"), s.start.alias("start"), s.kind.alias("kind")))
        return F.struct(F.when(s.start >= a.at, F.concat(a.cuts, cut)).otherwise(a.cuts).alias("cuts"), F.greatest(a.at, s.end).alias("at"))

    # Four bytes a code point: a stretch is cut out without counting from the start of the text.
    wide = F.encode(whole, "UTF-32")
    done = found.select(*kept).withColumn("_cuts", F.when(F.size(spans) > 0, F.aggregate(ordered, start, step)))
    done = done.withColumn("_wide", F.when(F.size(spans) > 0, wide))

    def stretch(low: Column, n: Column | None = None) -> Column:
        n = F.octet_length("_wide") if n is None else 4 * n
        # With a byte order mark in front, so that one in the text is not taken for it.
        cut = F.substring(F.col("_wide"), (4 * low + 1).cast("int"), n.cast("int"))
        return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), cut), "UTF-32")

    def label(kind: Column) -> Column:
        return F.when(kind == "removed", "").when(kind == "general", "[term]").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    parts = F.transform("_cuts.cuts", lambda c: F.concat(stretch(c.before, c.start - c.before), label(c.kind)))
    replaced = F.concat(F.array_join(parts, ""), stretch(F.col("_cuts.at")))
    text_of = {text: F.when(F.size(spans) > 0, replaced).otherwise(whole)}
    return done.select(*[text_of.get(c, F.col(f"in_{i}")).alias(c) for i, c in enumerate(columns)])
