"""Personal data: seeds by pattern, further identifiers by bootstrapping over their contexts. Built-in functions only.

Seeds are the e-mail addresses, network addresses, card and phone numbers that fixed patterns and checks find. The words
next to them are lexical patterns: "the one to three words before" and "the one to three words after". Candidates are runs
of digit groups (four digits or more, blanks and other separators of the seeds between them) and words with four digits
or an at sign, in what the seeds leave of the text. Patterns and values form a graph: a pattern is as good as the share of
its words' occurrences in the whole corpus that stand next to an accepted value, and a value next to a pattern of high confidence is
accepted in the next round and vouches for further patterns. At the end candidates in such contexts become spans of the
kind that the pattern's accepted values mostly have.

The scan of the texts happens once and keeps spans and contexts only; everything after works on that narrow table, which
is written to the shared folder. Counts of words and of graph edges combine before the shuffle, so a word that holds
a large part of the corpus is a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.core import let, scan
from refloom.llm.common import BLANK_CLASS, WORD_CLASS, text_of, words_of
from refloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract in a form that takes linear time: a run is entered at its start (or where the match
#: before ended) and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Groups of digits with the separators of the seeds between them, four digits or more; a word with four digits; a word
#: with an at sign.
CANDIDATE = (
    rf"(?<!{WORD_CLASS})(?:[^\x20\x09-\x0D0-9@]*+[0-9](?:[\x20().+-]*+[0-9]){{3,}}+"
    rf"|(?:[^\x20\x09-\x0D0-9]*+[0-9]){{4}}|[^\x20\x09-\x0D@]*+@){WORD_CLASS}*+"
)

#: A pattern counts if its accepted values are this many different ones, and are this share of its words' occurrences.
LEAST_VALUES, LEAST_CONFIDENCE, ROUNDS = 3, 0.8, 3
#: Words of a pattern at most, and the characters that are looked at first for them.
WORDS, _WINDOW = 3, 80
#: Bits of the table that keeps words which are in no pattern out of the shuffle.
_BITS = 1 << 22
_SPAN = "struct<start:int,kind:int,end:int>"


def _located(gaps: Column, found: Column) -> Column:
    """Start and end of each match from the lengths of the matches and of the texts between them."""
    parts = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    # split gives one text more than there are matches; the last has no match beside it.
    parts = F.filter(parts, lambda p: p["m"].isNotNull())

    def step(at: Column, p: Column) -> Column:
        start = at + p["g"]
        end = start + F.length(p["m"])
        return F.struct(
            end.alias("state"), F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m"))).alias("out")
        )

    return scan(parts, F.lit(0), step, "struct<start:int,end:int,m:string>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the seeds as an array of (start, kind, end), sorted; places are code points, the end is exclusive.

    The kind is the place in KINDS. `text` names a column without nulls.
    """
    t = F.col(text)
    kept = docs.columns
    for kind in KINDS:
        gate = t.contains(_GATES[kind]) if _GATES[kind] else F.lit(True)
        gate = gate & (F.lit(True) if kind == "email" else t.rlike("[0-9][^A-Za-z]*[0-9]"))
        found = F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))
        docs = docs.withColumn(f"_m_{kind}", F.when(gate, found).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        docs = docs.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(t, PATTERNS[kind], -1)))
    return docs.select(*kept, F.sort_array(F.concat(*[_seeds(k) for k in KINDS])).alias(out))


def _seeds(kind: str) -> Column:
    """The valid matches of one kind, from the columns that `with_base_spans` has made."""
    place = KINDS.index(kind)
    found = F.filter(_located(F.col(f"_g_{kind}"), F.col(f"_m_{kind}")), lambda x: _valid(kind, x["m"]))
    spans = F.transform(found, lambda x: F.struct(x["start"], F.lit(place).alias("kind"), x["end"]))
    return F.when(F.size(f"_m_{kind}") > 0, spans).otherwise(F.array()).cast(f"array<{_SPAN}>")


def _contexts(t: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Up to WORDS words before and as many after a span, in lower case and joined by blanks ("" at the ends of the text).

    A few characters hold them mostly; where they do not, the text up to its end is taken.
    """

    def words(parts: Column) -> Column:
        return F.filter(parts, lambda w: w != "")

    def cut(text: Column) -> Column:
        return F.split(F.lower(text), BLANK_CLASS + "+", -1)

    # The part at the span is glued to it ("" if none is), and the one at the other side of the window may be cut.
    first = F.greatest(start - _WINDOW, F.lit(0))
    before = let(
        cut(F.substr(t, first + 1, start - first)),
        lambda p: F.when((first == 0) | (F.size(p) > WORDS + 1), p).otherwise(cut(F.substr(t, F.lit(1), start))),
    )
    after = let(
        cut(F.substr(t, end + 1, F.lit(_WINDOW))),
        lambda p: F.when((end + _WINDOW >= F.length(t)) | (F.size(p) > WORDS + 1), p).otherwise(cut(F.substr(t, end + 1, F.length(t)))),
    )
    before = let(before, lambda p: F.when(F.element_at(p, -1) == "", _last(words(p))).otherwise(F.array().cast("array<string>")))
    after = F.slice(let(after, lambda p: words(F.slice(p, F.lit(2), F.size(p)))), 1, WORDS)
    return F.array_join(before, " "), F.array_join(after, " ")


def _last(words: Column) -> Column:
    return let(words, lambda w: F.slice(w, F.greatest(F.size(w) - (WORDS - 1), F.lit(1)), F.lit(WORDS)))


def _without(t: Column, spans: Column) -> Column:
    """The text with a tab for each character of the spans, which ends runs of digits and words alike."""

    def step(at: Column, s: Column) -> Column:
        start, end = F.greatest(at, s["start"]), F.greatest(at, s["end"])
        piece = F.concat(F.substr(t, at + 1, start - at), F.repeat(F.lit("\t"), end - start))
        return F.struct(end.alias("state"), F.array(piece).alias("out"))

    ends = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    rest = F.substr(t, ends + 1, F.length(t))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), rest)).otherwise(t)


def _patterns(side: str, words: Column) -> Column:
    """The patterns of a side: the next word, the next two, and so on up to WORDS."""
    sign = -1 if side == "before" else 1
    return F.array_distinct(F.array(*[F.substring_index(words, " ", sign * k) for k in range(1, WORDS + 1)]))


def _totals(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(word, total): how often each of the patterns occurs in the texts.

    A table of _BITS bits over the hashes of the patterns keeps most other words from being moved; the join is exact.
    """
    place = F.pmod(F.xxhash64("word"), F.lit(_BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    words_at = patterns.select(F.shiftright(place, 5).alias("_at"), place.bitwiseAND(31).alias("_bit"))
    # Every slot has a row, so the place in the sorted list is the slot.
    slots = docs.sparkSession.range(_BITS >> 5).select(F.col("id").cast("int").alias("_at"), F.lit(None).cast("int").alias("_bit"))
    slots = words_at.unionByName(slots).groupBy("_at").agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("_bits"))
    table = slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_bits"))), lambda x: x["_bits"]))

    def runs(a: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            out, run = [w], w
            for k in range(1, WORDS):
                run = F.concat(run, F.lit(" "), F.get(a, i + k))
                out.append(run)
            return F.array(*out)

        return F.flatten(F.transform(a, at))

    words = docs.select(F.explode(let(words_of(F.lower(text_of(text_col))), runs)).alias("word")).where("word is not null")
    bits = F.call_function("shiftright", F.get(table.scalar(), F.shiftright(place, 5)), place.bitwiseAND(31))
    hit = bits.bitwiseAND(F.lit(1).cast("long")) == 1
    return words.where(hit).groupBy("word").agg(F.count("*").alias("total"))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base, places): seeds per row, and seeds and candidates with their contexts. Written once.

    key stands for id and text, so that rows that repeat have equal spans.
    """
    t = F.col("_t")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    rows = with_base_spans(rows, "_t", "_base")
    rows = rows.withColumn("_u", _without(t, F.col("_base")))
    some = F.regexp_extract_all("_u", F.lit(CANDIDATE), F.lit(0))
    rows = rows.withColumn("_m", F.when(F.col("_u").rlike("[0-9@]"), some).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_g", F.when(F.size("_m") > 0, F.split("_u", CANDIDATE, -1)))

    def bare(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], r"^[\"'(<\[{]*", 0))
        core = F.regexp_replace(x["m"], r"^[\"'(<\[{]*+|[\"')>\]},.;:!?]*+$", "")
        return F.struct(
            (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("m")
        )

    cands = F.transform(_located(F.col("_g"), F.col("_m")), bare)
    cands = F.filter(cands, lambda c: F.length(c["m"]) > 0)
    rows = rows.withColumn("_cands", F.when(F.size("_m") > 0, cands).otherwise(F.array()).cast("array<struct<start:int,end:int,m:string>>"))

    def place(start: Column, kind: Column, end: Column, value: Column) -> Column:
        before, after = _contexts(t, start, end)
        return F.struct(
            start.alias("start"),
            kind.alias("kind"),
            end.alias("end"),
            F.xxhash64(value).alias("value"),
            before.alias("before"),
            after.alias("after"),
        )

    seeds = F.transform("_base", lambda b: place(b["start"], b["kind"], b["end"], F.substr(t, b["start"] + 1, b["end"] - b["start"])))
    others = F.transform("_cands", lambda c: place(c["start"], F.lit(None).cast("int"), c["end"], c["m"]))
    rows = rows.select(
        "_id", F.xxhash64("_id", "_t").alias("_key"), "_base", F.concat(seeds, others).alias("_places")
    )
    return materialize(rows, "pii")


def learned_patterns(
    docs: DataFrame,
    places: DataFrame,
    text_col: str = "text",
    least_values: int = LEAST_VALUES,
    least_confidence: float = LEAST_CONFIDENCE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(side, word, kind, confidence) of the patterns of high confidence.

    Patterns that could not reach the bounds even if all their candidates were accepted are dropped before the rounds.
    A value has the kind of its seeds or of the best pattern that brought it, a pattern the kind most of its hits have.
    """
    def named(side: str) -> Column:
        return F.transform(_patterns(side, F.col(side)), lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))

    sides = F.explode(F.concat(named("before"), named("after")))
    edges = places.select("kind", "value", sides.alias("p")).where("p.word <> ''")
    edges = edges.groupBy("p.side", "p.word", "value", "kind").agg(F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    hopeful = edges.groupBy("side", "word", "value").agg(F.sum("n").alias("n"))
    hopeful = hopeful.groupBy("side", "word").agg(F.sum("n").alias("most"), F.count("*").alias("values"))
    hopeful = materialize(hopeful.where(F.col("values") >= least_values).drop("values"), "pii-hopeful")
    total = _totals(docs, text_col, hopeful)
    hopeful = hopeful.join(total, "word").where(F.col("most") >= least_confidence * F.col("total"))
    hopeful = materialize(hopeful.select("side", "word", "total"), "pii-hopeful")
    edges = materialize(edges.join(hopeful, ["side", "word"]), "pii-edges")
    accepted = edges.where("kind is not null").groupBy("value", "kind").agg(F.sum("n").alias("n"))
    accepted = accepted.groupBy("value").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("as_kind"))
    accepted = materialize(accepted, "pii-values")
    edges = edges.groupBy("side", "word", "total", "value").agg(F.sum("n").alias("n"))
    edges = materialize(edges, "pii-edges")
    good = None
    for _ in range(rounds):
        scored = edges.join(accepted, "value").groupBy("side", "word", "total").agg(
            F.sum("n").alias("hits"),
            F.count("*").alias("values"),
            *[F.sum(F.when(F.col("as_kind") == k, F.col("n")).otherwise(0)).alias(f"hits_{k}") for k in range(len(KINDS))],
        )
        most = F.array_max(F.array(*[F.struct(F.col(f"hits_{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))]))
        scored = scored.withColumn("confidence", F.col("hits") / F.col("total")).withColumn("kind", -most["k"])
        good = scored.where((F.col("values") >= least_values) & (F.col("confidence") >= least_confidence))
        good = materialize(good.select("side", "word", "kind", "confidence"), "pii-good")
        brought = edges.join(good, ["side", "word"]).groupBy("value").agg(
            F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("as_kind")
        )
        accepted = accepted.unionByName(brought.join(accepted, "value", "left_anti"))
        accepted = materialize(accepted, "pii-values")
    return good


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: float) -> DataFrame:
    """(id, key, base, spans) per row; base and spans are sorted arrays of (start, kind, end), base a part of spans.

    Null and empty texts have no spans. Rows that repeat in id and text have equal spans; a null id keeps its row; columns
    besides id and text are ignored, whatever their names. Spans that start at one place are ordered by kind; of kinds that a pattern
    could bring the one with more evidence is taken, the first as listed where equal. Texts of any length are read whole; an empty table
    gives no rows.
    """
    rows = scanned(docs, id_col, text_col)
    places = rows.select("_key", F.inline("_places"))
    patterns = learned_patterns(docs, places, text_col, **bounds)
    cands = places.where("kind is null").drop("kind")
    near = [
        cands.select("_key", "start", "end", F.lit(side).alias("side"), F.explode(_patterns(side, F.col(side))).alias("word"))
        .where("word <> ''")
        for side in ("before", "after")
    ]
    hits = near[0].unionByName(near[1]).join(patterns, ["side", "word"])
    hits = hits.groupBy("_key", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    hits = hits.groupBy("_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("_more"))
    rows = rows.join(hits, "_key", "left")
    more = F.coalesce("_more", F.array().cast(f"array<{_SPAN}>"))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_key").alias("key"),
        F.col("_base").alias("base"),
        F.sort_array(F.concat("_base", more)).alias("spans"),
    )


def n_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    place = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(at: Column, s: Column) -> Column:
        apart = F.concat(F.substr(text, at + 1, s["start"] - at), F.get(names, s["kind"]))
        piece = F.when(s["start"] >= at, apart).otherwise(F.lit(""))
        return F.struct(F.greatest(at, s["end"]).alias("state"), F.array(piece).alias("out"))

    ends = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    rest = F.substr(text, ends + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), rest)).otherwise(text)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs with the spans in their texts masked, and their length in code points where docs has such a column.

    Null texts stay null. Columns and their order are those of docs.
    """
    spans = find(docs, id_col, text_col).where(F.size("spans") > 0)
    spans = spans.groupBy("key").agg(F.first("spans").alias("spans"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("key"))
    joined = keyed.join(spans, "key", "left")
    text = F.col("row").getField(text_col)
    none = F.array().cast(f"array<{_SPAN}>")
    joined = joined.withColumn("text", masked(text, F.coalesce("spans", none)))
    new = {text_col: F.col("text")}
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        new[size_col] = F.when(F.col("spans").isNull(), F.col("row").getField(size_col)).otherwise(F.length("text").cast(kind))
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
