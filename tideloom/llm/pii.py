"""Personal data: fixed patterns, and identifiers found from their contexts.

The base spans are regular expression matches of four kinds. They, and runs of
hex digits that look like keys, seed a bootstrap. Each match induces lexical
patterns from the text around it: the word before it with the punctuation
between, two words, the word and what follows the match, and the punctuation
alone with the shape of the match. Patterns and the strings they introduce form
a graph. In each round a pattern is trusted for a kind by the share of its
strings that are of that kind, so that strings of other kinds and unknown ones
count against it, and strings that trusted patterns introduce join the kind.
Strings that look like identifiers and end up in a kind are found wherever they
occur. Keys are no exception: shape alone doesn't make one a find.

All of it is SQL expressions. Documents without a digit or an @ sign skip the
matching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Each matches what the plain pattern beside it matches, but starts only where
#: such a match can start and never backs up, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs of six or more with four digits at least: what may be an identifier.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=(?:[A-Za-z_-]*+[0-9]){4})[A-Za-z0-9_-]{6,}+"
BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What seeds the kind ``key``.
KEY = "^(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{16,}$"
#: Rounds; distinct strings of a kind a pattern needs; the least trust in a
#: pattern that is heard; the least score of a string that is of a kind; what a
#: string of unknown kind counts against a pattern, one of another kind being 1.
ROUNDS, SUPPORT, HEARD, TRUSTED, UNKNOWN = 4, 3, 0.5, 0.75, 0.5
#: Characters before a match that its patterns are taken from.
CONTEXT = 64

_DIGITS = "regexp_replace(m.text, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + if(i % 2 = 1,
    int(substring(reverse({_DIGITS}), i, 1)),
    int(substring('0246813579', int(substring(reverse({_DIGITS}), i, 1)) + 1, 1)))) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": f"m.text rlike '^0*{BYTE}[.]0*{BYTE}[.]0*{BYTE}[.]0*{BYTE}$'",
    "card": f"length({_DIGITS}) between 13 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_SPAN = "struct<kind:string,start:bigint,end:bigint,text:string,before:string,after:string>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(kind: str, pattern: str, gate: str, text: str = "text") -> str:
    """SQL for the spans of ``pattern`` in order, in code points, each with the
    CONTEXT characters of text before it and the one after it. Pieces between
    matches and matches take turns, so running lengths are the positions.
    ``gate`` is a cheap necessary test."""
    p = _quoted(pattern)
    step = f"""(a, z) -> named_struct('at', a.at + length(z.t.piece) + length(z.t.hit),
        'tail', right(concat(a.tail, right(z.t.piece, {CONTEXT}), right(z.t.hit, {CONTEXT})), {CONTEXT}),
        'out', concat(a.out, array(named_struct('kind', '{kind}', 'start', a.at + length(z.t.piece), 'end', a.at + length(z.t.piece) + length(z.t.hit),
            'text', z.t.hit, 'before', right(concat(a.tail, right(z.t.piece, {CONTEXT})), {CONTEXT}), 'after', left(z.next, 1)))))"""
    hits = f"regexp_extract_all({text}, {p}, 0)"
    found = f"""transform(array(named_struct('pieces', split({text}, {p}, -1), 'hits', {hits})), b -> aggregate(
        zip_with(zip_with(slice(b.pieces, 1, size(b.hits)), b.hits, (piece, hit) -> named_struct('piece', piece, 'hit', hit)),
            slice(b.pieces, 2, size(b.hits)), (t, next) -> named_struct('t', t, 'next', next)),
        named_struct('at', 0L, 'tail', '', 'out', cast(array() as array<{_SPAN}>)), {step}).out)[0]"""
    return f"if({gate}, {found}, cast(array() as array<{_SPAN}>))"


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, m -> concat_ws(':', m.kind, m.start, m.end)), ',')"


#: The last two words before a match, and the punctuation between, without spaces and quotes.
_WORDS = r"([\p{L}\p{N}_-]+)?[^\p{L}\p{N}_]*?([\p{L}\p{N}_-]*[\p{L}\p{N}_])?[^\p{L}\p{N}_]*$"
_SHAPE = """concat(case when m.text rlike '^[0-9]+$' then 'digits' when m.text rlike '^[0-9a-fA-F]+$' then 'hex' when m.text rlike '^[0-9A-Za-z]+$' then 'letters and digits' else 'mixed' end)"""


def patterns_of(m: str = "m") -> str:
    """SQL for the lexical patterns of a span ``m``."""
    word = f"lower(regexp_extract({m}.before, {_quoted(_WORDS)}, 2))"
    first = f"lower(regexp_extract({m}.before, {_quoted(_WORDS)}, 1))"
    marks = f"""regexp_replace(regexp_extract({m}.before, {_quoted(r"[^\p{L}\p{N}_]*$")}, 0), {_quoted("[\\s\"'`]+")}, '')"""
    after = f"regexp_extract({m}.after, {_quoted(r"[^\p{L}\p{N}_\s]")}, 0)"
    shape = _SHAPE.replace("m.text", f"{m}.text")
    return f"""filter(transform(array(named_struct('first', {first}, 'word', {word}, 'marks', {marks}, 'after', {after}, 'shape', {shape})), c -> array(
        if(c.word != '', concat('word ', c.word, c.marks), null),
        if(c.first != '' and c.word != '', concat('words ', c.first, ' ', c.word, c.marks), null),
        if(c.word != '' and c.after != '', concat('around ', c.word, c.marks, ' ', c.after), null),
        if(c.marks != '', concat('marks ', c.marks, ' ', c.shape), null)))[0], p -> p is not null)"""


def trusted_strings(graph: DataFrame) -> DataFrame:
    """(instance, kind) of strings that bootstrapping puts in a kind, from the
    links (pattern, instance, kind) of a graph, the kind being that of a seed and
    null for others. Seeds whose patterns don't bear them out aren't told."""
    kinds = [*PATTERNS, "key"]
    best = lambda x: F.coalesce(*[F.when(F.col(f"{x}_{k}") == F.greatest(*[F.col(f"{x}_{j}") for j in kinds]), k) for k in kinds])
    label = graph.withColumn("label", F.col("kind"))
    for turn in range(ROUNDS):
        # By kind in columns of plain numbers, which add up before the shuffle.
        counts = [F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"n_{k}") for k in kinds]
        against = F.sum(F.when(F.col("label").isNull(), UNKNOWN).otherwise(1.0)).alias("n")
        trust = label.groupBy("pattern").agg(against, *counts).withColumn("most", F.greatest(*[f"n_{k}" for k in kinds]))
        trust = trust.withColumn("trust", F.col("most") / (F.col("n") + 1)).where((F.col("most") >= SUPPORT) & (F.col("trust") >= HEARD)).select("pattern", best("n").alias("by"), "trust")
        scores = [(1 - F.exp(F.sum(F.when(F.col("by") == k, F.log1p(-F.col("trust"))).otherwise(0.0)))).alias(f"score_{k}") for k in kinds]
        heard = graph.join(trust, "pattern").groupBy("instance").agg(*scores)
        heard = heard.where(F.greatest(*[f"score_{k}" for k in kinds]) >= TRUSTED).select("instance", best("score").alias("by"))
        if turn == ROUNDS - 1:
            return heard.select("instance", F.col("by").alias("kind"))
        label = written(graph.join(heard, "instance", "left").select("pattern", "instance", "kind", F.coalesce("kind", "by").alias("label")))
    raise AssertionError


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found) per row of ``docs``: spans of the four base kinds, in
    order of kind and start, and identifiers found by context (kind ``id``, with
    the kind they were found as).

    Positions are in code points, the end exclusive; matches don't overlap
    within a kind, and ones that fail their kind's test are dropped without
    another try. A null or empty text has no spans; repeated rows are scanned
    each for itself, and copies of a passage count once in the graph; a null id
    is kept. Other columns aren't read.
    """
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digit, at = "text rlike '[0-9]'", "contains(text, '@')"
    gates = {"email": at, "ip": digit, "card": digit, "phone": f"contains(text, '+') and {digit}"}
    raw = text.select("id", *[F.expr(matches(k, p, gates[k])).alias(k) for k, p in PATTERNS.items()], F.expr(matches("id", CANDIDATE, digit)).alias("maybe"))
    good = raw.select("id", *[F.expr(f"filter({k}, m -> {VALID[k]})").alias(k) for k in PATTERNS], "maybe")
    apart = "filter(maybe, c -> not exists(base, m -> m.start < c.end and c.start < m.end))"
    rows = good.select("id", F.concat(*PATTERNS).alias("base"), "maybe").withColumn("maybe", F.expr(apart)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows)

    spans = rows.select(F.explode(F.concat("base", "maybe")).alias("m"))
    kind = F.when(F.col("m.kind") != "id", F.col("m.kind")).when(F.col("m.text").rlike(KEY), "key")
    told = spans.select(F.explode(F.expr(patterns_of())).alias("pattern"), F.concat_ws(":", F.when(F.col("m.kind") == "id", "id").otherwise(F.lit("base")), "m.text").alias("instance"), kind.alias("kind"))
    graph = written(told.distinct())
    known = trusted_strings(graph).where(F.startswith("instance", F.lit("id:"))).select(F.expr("substring(instance, 4)").alias("known"), F.col("kind").alias("as"))

    again = rows.select("row", F.explode("maybe").alias("m")).join(known, F.col("m.text") == F.col("known"))
    found = again.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("m.start", "m.end", "m.kind", "m.text", "as"))).alias("found"))
    none = "cast(array() as array<struct<start:bigint,end:bigint,kind:string,text:string,as:string>>)"
    return rows.join(found, "row", "left").select("id", "base", F.coalesce("found", F.expr(none)).alias("found"))
