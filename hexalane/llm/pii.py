"""Personal data: base patterns, then information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
The method then asks which other terms give a protected entity away: the corpus
estimates, for an entity ``e`` and a term ``t``, the share of the information of
``e`` that ``t`` reveals,

    disclosure(e, t) = PMI(e; t) / IC(e) = 1 + log2 p(e | t) / log2(1 / p(e)),

which is 1 when every text with the term has the entity and 0 when the two are
independent (Sanchez, Batet and Viejo, 2013).  Texts are counted once however
often they are copied.  A term at or above ``REMOVE`` is removed, one at or above
``GENERALISE`` is generalised to its kind; both become spans of the texts that
hold the entity.

Everything is DataFrame functions: positions come from splitting a text at a
pattern and adding up lengths.  Counts are map-side combined aggregates over all
texts; the terms looked at are all those of the texts that hold an entity, and
only terms rare enough to disclose any entity meet the entities of their texts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import drop_path, materialise

# The base kinds in their order, with their patterns.  Repeated groups are possessive: nothing follows
# them, so they match the same, but Java's regex engine does not recurse once per repetition on very long runs.  An e-mail
# address or a number begins where its run of characters does, or right after the match before (\G); saying so matches the
# same, too, and keeps a long run without a match from being tried from each of its characters.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this cheap test has no base span of the kind.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Rows of a table of numbers or terms that may be broadcast: texts with copies, entities of several texts and frequent terms;
#: 500,000 pairs of longs are 8 MB.
BROADCAST_COPIES = 500_000
REMOVE, GENERALISE = 0.95, 0.8
#: Numbers that a running total takes at a time.
CHUNK = 256
TERM = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body (or a function within it) reads it."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column, op) -> Column:
    """What ``op`` makes of the numbers before each one, beginning with 0.

    In chunks: appending to an array copies it, so a single fold would take the
    square of the length.
    """
    none = F.array().cast("array<int>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("out"))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def totals(given):
        starts = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda i: F.slice(given, i * CHUNK + 1, F.lit(CHUNK)))
        local = F.transform(chunks, lambda c: F.aggregate(c, empty, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))))
        merged = F.aggregate(local, whole, lambda s, c: F.struct(op(s["at"], c["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(c["out"], lambda o: op(s["at"], o)))).alias("out")), lambda s: s["out"])
        return F.when(F.size(given) > 0, F.flatten(merged)).otherwise(none)

    return _let(numbers, totals)


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<value, start, end>>`` of all leftmost matches of a pattern, in code points, end exclusive."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sized = lambda x, gap: F.struct(x.alias("value"), gap.alias("gap"), F.char_length(x).alias("size"))
    paired = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.zip_with(v, F.slice(gaps, F.lit(1), F.size(v)), sized))

    def placed(found):
        before = _running(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, x: a + x)
        return F.zip_with(found, before, lambda x, at: F.struct(x["value"].alias("value"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end")))

    return _let(paired, placed)


def _spans_of(text: Column, kind: str) -> Column:
    """``array<struct<kind, start, end, value>>`` of all leftmost matches of a kind's pattern, unfiltered."""
    return F.transform(_matches(text, PATTERNS[kind]), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(marks, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str):
    def test(span):
        value = span["value"]
        if kind == "email":
            return F.lit(True)
        if kind == "ip":
            # leading zeros do not count; a part of four digits or more is over 255
            return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255))
        n = F.char_length(_digits(value))
        if kind == "card":
            return n.between(16, 19) & _luhn(_digits(value))
        return n.between(8, 15)

    return test


def base_spans(text: Column) -> Column:
    """All base spans of a text (null counts as empty) by kind, then start."""
    safe = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.concat(*[F.when(F.rlike(safe, F.lit(HINTS[k])), F.filter(_spans_of(safe, k), _valid(k))).otherwise(none) for k in KINDS])


def _entity(span: Column) -> Column:
    """The name under which equal entities of different writing meet."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _between(text: Column, spans: Column, shown) -> Column:
    """The text with what ``shown`` makes of a span in place of every one; a span that begins within an earlier one is left out.

    ``spans`` are structs of ``start, end`` and more fields, sorted.
    """

    def pieces(given):
        reached = _running(F.transform(given, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        kept = F.zip_with(given, reached, lambda s, at: F.concat(F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0))), F.when(s["start"] >= at, shown(s)).otherwise(F.lit(""))))
        last = F.coalesce(F.array_max(F.transform(given, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(kept, ""), F.substring(text, last + 1, F.char_length(text)))

    return _let(spans, pieces)


def _outside(text: Column, base: Column) -> Column:
    """The text with a line break in place of every base span."""
    return _between(text, F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["end"]))), lambda s: F.lit("\n"))


def _small(table: DataFrame) -> DataFrame:
    """Broadcast behind a count."""
    return F.broadcast(table) if table.count() <= BROADCAST_COPIES else table


#: Pairs of a text's terms and entities that are counted in one place.
PAIRS = 1 << 22


def _same_texts(inside: Column | None = None) -> list[Column]:
    """Two hashes of the set of texts ``t``; with their number they tell sets apart."""
    inside = F.lit(True) if inside is None else inside
    mark = lambda seed: F.bit_xor(F.when(inside, F.xxhash64("t", F.lit(seed)))).alias(f"x{seed}")
    return [mark(1), mark(2)]


@dataclass
class _Judged:
    """What the corpus says: ``terms`` (``t, tc, term``), ``entities`` (``t, ec, entity``) and ``pairs`` (``t, ec, tc, disclosure``).

    Terms that stand in the same texts are one class ``tc``, and so are entities,
    ``ec``: all members of a class disclose alike.  The terms and the entities of one
    text only are thus one class each, whatever their number.
    """

    terms: DataFrame
    entities: DataFrame
    pairs: DataFrame


def _judged(docs: DataFrame, entities: DataFrame, text_col: str, threshold: float) -> _Judged | None:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = entities.select(F.xxhash64("text").alias("t"), "text", "base").dropDuplicates(["t"])
    every, free = _terms(F.col("text")), _terms(_outside(F.col("text"), F.col("base")))
    held = held.select("t", F.array_distinct(F.transform("base", _entity)).alias("entities"), F.array_distinct(every).alias("every"), free.alias("free"))
    found = held.select("t", "entities", F.array_intersect("every", "free").alias("free"), F.array_except("every", "free").alias("hidden"))
    places = F.ceil(F.size("entities").cast("double") * F.size("free") / PAIRS).cast("int")
    found = materialise(found.withColumn("places", F.greatest(places, F.lit(1))), "found")
    n_found = found.count()
    if not n_found:
        return None
    mentions = found.select("t", "places", F.explode("entities").alias("entity"))
    several = materialise(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *_same_texts()).where("n_entity > 1"), "entity_texts")
    most = several.agg(F.max("n_entity")).first()[0] or 1
    # every text counts by its share among its copies, so that the counts of a term combine on the map side
    copies = materialise(docs.select(F.xxhash64(text).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("copies")), "copies")
    corpus = float(copies.count())
    shared = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).join(_small(copies.where("copies > 1")), "t", "left")
    holding = shared.select((1.0 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    term_texts = holding.groupBy("term").agg(F.round(F.sum("share")).alias("n_term"))
    side = F.explode(F.concat(F.transform("free", lambda x: F.struct(x.alias("term"), F.lit(1).alias("free"))), F.transform("hidden", lambda x: F.struct(x.alias("term"), F.lit(0).alias("free")))))
    beside = found.select("t", side.alias("x")).select("t", "x.*").groupBy("term").agg(F.sum("free").alias("n_free"), F.sum(1 - F.col("free")).alias("n_hidden"), *_same_texts(F.col("free") == 1)).where("n_free > 0")
    counted = beside.join(term_texts, "term").select("term", "n_free", (F.col("n_term") - F.col("n_hidden")).alias("n_term"), F.xxhash64("n_free", "x1", "x2", F.col("n_term") - F.col("n_hidden")).alias("tc"))
    # lossless: both are in at most min(n_free, n_entity) texts, so no entity can bring a term above this bound to the threshold
    bound = F.pow(F.least(F.col("n_free"), F.lit(most)).cast("double"), F.lit(threshold)) * corpus ** (1 - threshold) * (1 + 1e-9)
    counted = materialise(counted.withColumn("can", F.col("n_term") <= bound), "term_texts")
    # of the terms that cannot, the frequent ones leave before the shuffle: at most 1,000 times the terms of a mean text
    frequent = counted.where(~F.col("can") & (F.col("n_free") * 1000 > n_found)).select("term")
    rare = found.select("t", "places", F.explode("free").alias("term")).join(_small(frequent), "term", "left_anti").join(counted.where("can").select("term", "n_term", "tc"), "term")
    rare = materialise(rare, "rare")
    # an entity of one text is of the class of that text
    known = several.select("entity", "n_entity", F.xxhash64("n_entity", "x1", "x2").alias("ec"))
    named = mentions.join(_small(known), "entity", "left").select("t", "places", "entity", F.coalesce("ec", F.xxhash64("t", F.lit("alone"))).alias("ec"), F.coalesce("n_entity", F.lit(1)).alias("n_entity"))
    named = materialise(named, "named")
    # classes meet within their text, a text of many of both in several places; the sizes on disk say nothing, so no side is broadcast
    left = rare.select("t", "places", "tc", "n_term").dropDuplicates(["t", "tc"]).withColumn("place", F.pmod("tc", F.col("places")).cast("int")).drop("places")
    right = named.dropDuplicates(["t", "ec"]).select("t", "ec", "n_entity", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    both = materialise(left.hint("merge").join(right.hint("merge"), ["t", "place"]).drop("place"), "both")
    pairs = both.groupBy("ec", "tc").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_term").alias("n_term"), F.max("n_entity").alias("n_entity"))
    total = F.lit(corpus)
    ic = F.log2(total / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    judged = pairs.withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))).where(F.col("disclosure") >= threshold)
    met = both.select("t", "ec", "tc").hint("merge").join(judged.select("ec", "tc", "disclosure").hint("merge"), ["ec", "tc"])
    for done in (found, several, copies, counted):
        drop_path(docs.sparkSession, done)
    return _Judged(rare.select("t", "tc", "term"), named.select("t", "ec", "entity"), met)


def _action(disclosure: Column) -> Column:
    return F.when(disclosure >= REMOVE, "removed").otherwise("generalised")


def disclosures(docs: DataFrame, entities: DataFrame, text_col: str = "text", threshold: float = GENERALISE) -> DataFrame:
    """``t, entity, term, action, disclosure``: the terms that disclose an entity, for every text ``t`` (a hash) with both.

    ``entities`` holds the texts with base spans (``text, base``), ``docs`` all
    texts.  Counts are over distinct texts; a term counts where it stands outside
    of base spans.  Every entity and every such term is judged, however rare.  A row
    per text, entity and term: :func:`sanitise` does not write them out.
    """
    given = _judged(docs, entities, text_col, threshold)
    if given is None:
        return docs.sparkSession.createDataFrame([], "t long, entity string, term string, action string, disclosure double")
    return given.pairs.join(given.terms, ["t", "tc"]).join(given.entities, ["t", "ec"]).select("t", "entity", "term", _action(F.col("disclosure")).alias("action"), "disclosure")


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of the disclosing terms in a text: whole words, any case."""
    named = F.transform(_matches(text, TERM), lambda m: F.struct(F.element_at(terms, F.lower(m["value"])).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.filter(named, lambda s: s["kind"].isNotNull())


#: Characters times terms or base spans of a text up to which its words are looked up where they stand.
SHORT = 1 << 27


def _far_spans(texts: DataFrame, given: DataFrame) -> DataFrame:
    """``t, extra``: spans of the disclosing terms of long texts (``t, text, base``), by joins and one window per text.

    A word overlaps a base span if, of the base spans that begin before its end, the
    furthest ends after its start.
    """
    word = texts.select("t", F.explode(_matches(F.col("text"), TERM)).alias("m")).select("t", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value"), F.lower("m.value").alias("term"))
    named = word.join(given, ["t", "term"]).select("t", F.col("end").alias("at"), F.lit(0).alias("side"), "start", "end", "value", "action")
    base = texts.select("t", F.explode("base").alias("b")).select("t", F.col("b.start").alias("at"), F.lit(1).alias("side"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))
    reach = F.max(F.when(F.col("side") == 1, F.col("end"))).over(Window.partitionBy("t").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    free = named.unionByName(base, allowMissingColumns=True).withColumn("reach", reach).where((F.col("side") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "action", "value")))
    return free.groupBy("t").agg(F.transform(spans, lambda x: F.struct(x["action"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).alias("extra"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id, base, extra`` (and the ``text``) for every row: base spans and the spans that the method adds.

    Spans are structs of kind, start and end in code points (end exclusive) and
    value; those added have the kinds ``removed`` and ``generalised`` and never
    overlap a base span.  A null text counts as empty and has no spans; null ids
    stay; repeated rows get equal spans.  A text without base spans gets none
    added.  Terms of equal disclosure are all treated alike, so ties need no rule.
    Texts are read whole; the words of texts long in characters, terms and spans are
    looked up by joins.  An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("base", base_spans(F.col("text")))
    kept = ["id", "base", "extra", *(["text"] if with_text else [])]
    with_entities = base.where(F.size("base") > 0).withColumns({"t": F.xxhash64("text"), "n_chars": F.char_length("text"), "n_base": F.size("base")})
    with_entities = materialise(with_entities, "entities")
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    plain = base.where(F.size("base") == 0).withColumns({"base": nothing, "extra": nothing}).select(*kept)
    known = _judged(docs, with_entities, text_col, GENERALISE)
    if known is None:
        return plain.unionByName(with_entities.withColumn("extra", nothing).select(*kept))
    # the strongest disclosure of each class of a text is that of its terms
    best = known.pairs.groupBy("t", "tc").agg(F.max("disclosure").alias("disclosure"))
    given = materialise(known.terms.hint("merge").join(best.hint("merge"), ["t", "tc"]).select("t", "term", _action(F.col("disclosure")).alias("action")), "disclosures")
    # the terms that each text must lose, gathered per text
    text_terms = given.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("terms"), F.count(F.lit(1)).alias("n_terms"))
    long = F.col("n_chars").cast("double") * F.greatest("n_terms", "n_base") > SHORT
    heavy = materialise(with_entities.select("t", "n_chars", "n_base").distinct().join(given.groupBy("t").agg(F.count(F.lit(1)).alias("n_terms")), "t").where(long).select("t"), "long")
    far = not heavy.isEmpty()
    marked = with_entities.join(text_terms, "t", "left")
    if far:
        marked = marked.join(_small(heavy.withColumn("far", F.lit(True))), "t", "left")
    free = lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))
    near = F.col("far").isNull() if far else F.lit(True)
    extra = F.when(F.col("terms").isNotNull() & near, F.filter(_term_spans(F.col("text"), F.col("terms")), free)).otherwise(nothing)
    marked = marked.withColumn("extra", extra)
    if far:
        texts = with_entities.join(_small(heavy), "t", "left_semi").select("t", "text", "base").dropDuplicates(["t"])
        spans = _far_spans(texts, given.join(_small(heavy), "t", "left_semi")).withColumnRenamed("extra", "beyond")
        marked = marked.join(spans, "t", "left").withColumn("extra", F.coalesce("beyond", "extra"))
    return plain.unionByName(marked.select(*kept))


def general(value: Column) -> Column:
    """The next wider concept of a term, by its form: a number, a name (written with a capital letter), or any term."""
    return F.when(value.rlike(r"^\p{N}"), "[NUMBER]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def redact(text: Column, base: Column, extra: Column) -> Column:
    """The text with base spans replaced by their kind, generalised terms by their wider concept, and removed terms left out."""
    spans = F.array_sort(F.transform(F.concat(base, extra), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    shown = lambda s: F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", general(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return _between(F.coalesce(text, F.lit("")), spans, shown)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
