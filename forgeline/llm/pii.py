"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; those are the seeds.
What stands around a seed makes lexical patterns: the two words before it, the one word before it, the two words after
it, and the template of one word on either side (``phone = "..." end``); a line's start and end count as words. Patterns and
instances form a graph, over which scores go back and forth: a pattern is as reliable as the share of its instances
that are known, an instance as likely as the patterns that it occurs in make it. Identifier-like strings in reliable
patterns are found too, though no base pattern knows their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.llm.common import quoted, without, written

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive where going back can't help, so that long runs take linear time
# and no stack; runs are entered at their start or where the last match ended. Cards of under 16 digits
# would be dropped and take nothing from others.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(x.hit, '[^0-9]', '')"
_LUHN = f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + IF(i % 2 = 0, array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[CAST(substr(reverse({_DIGITS}), i, 1) AS INT)], CAST(substr(reverse({_DIGITS}), i, 1) AS INT))) % 10 = 0"
VALID = {
    "email": "true",
    "ip": rf"x.hit RLIKE r'^{_BYTE}(?:\.{_BYTE}){{3}}$'",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
# An identifier-like string: digits in groups, or a run of letters and digits with a digit or an @.
TOKEN = r"(?<![A-Za-z0-9@._%+-])(?:\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9@])|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+)"
#: Characters before and after a mention in which its words are looked for, as far as the second match of the same pattern beside it.
CONTEXT = 64
#: Rounds of scoring; seeds that a pattern needs; reliability from which it is believed, and finds (three seeds and one find reach 0.74).
ROUNDS, SUPPORT, BELIEVED, FINDS = 3, 3, 0.5, 0.7
#: Found spans are sent to all tasks up to this number (each takes 16 bytes and its row's number); more are joined.
SENT_SPANS = 100_000

_MATCH = "s: int, e: int, hit: string, before: string, after: string"
# Running sums of the lengths of gaps and hits, in blocks of about the square root of their number, so that no array is copied for each match:
# first the sum of each block and what stands before it, then the places within each block. A match's context comes from the
# gaps and hits beside it, at most two hits away, as cutting it out of the whole text would count characters from the start each time.
_PLACES = """CASE WHEN size({h}) = 0 THEN CAST(array() AS array<struct<{match}>>) ELSE
flatten(zip_with({sums}, sequence(0, {count} - 1), (at, b) ->
  aggregate(sequence(b * {width}, least((b + 1) * {width}, size({h})) - 1),
    struct(at AS at, CAST(array() AS array<struct<{match}>>) AS found),
    (a, i) -> struct(a.at + length({p}[i]) + length({h}[i]) AS at,
      array_append(a.found, struct(a.at + length({p}[i]) AS s, a.at + length({p}[i]) + length({h}[i]) AS e, {h}[i] AS hit, {before} AS before, {after} AS after)) AS found),
    a -> a.found))) END"""
_SUMS = """slice(aggregate(sequence(0, {count} - 1), array(0), (sums, b) -> array_append(sums, element_at(sums, -1)
  + aggregate(sequence(b * {width}, least((b + 1) * {width}, size({h})) - 1), 0, (n, i) -> n + length({p}[i]) + length({h}[i])))), 1, {count})"""
_BEFORE = """right(concat(IF(i < 3, char(10), ''), IF(i > 1, concat(right({p}[i - 2], {c}), right({h}[i - 2], {c})), ''),
  IF(i > 0, concat(right({p}[i - 1], {c}), right({h}[i - 1], {c})), ''), right({p}[i], {c})), {c})"""
_AFTER = """left(concat(left({p}[i + 1], {c}), IF(i + 1 < size({h}), concat(left({h}[i + 1], {c}), left({p}[i + 2], {c})), ''),
  IF(i + 2 < size({h}), concat(left({h}[i + 2], {c}), left({p}[i + 3], {c})), ''), IF(i + 3 >= size({h}), char(10), '')), {c})"""


def _places(hits: str, gaps: str) -> str:
    """SQL: the matches as an array of (s, e, hit, before, after); a text's start and end count as line breaks."""
    names = {"h": hits, "p": gaps, "c": CONTEXT, "match": _MATCH}
    names["width"] = "CAST(ceil(sqrt(size({h}))) AS INT)".format(**names)
    names["count"] = "CAST(ceil(size({h}) / {width}) AS INT)".format(**names)
    return _PLACES.format(**names, sums=_SUMS.format(**names), before=_BEFORE.format(**names), after=_AFTER.format(**names))


def _matches(df: DataFrame, text: str, patterns: dict[str, str], gates: dict[str, Column]) -> DataFrame:
    """df with, for each name, the array of all matches: places in code points and strings."""
    parts = []
    for name, pattern in patterns.items():
        none = F.array().cast("array<string>")
        parts += [F.when(gates[name], F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"__h_{name}"), F.when(gates[name], F.split(text, pattern, -1)).otherwise(none).alias(f"__p_{name}")]
    cut = df.select("*", *parts)
    return cut.select(*[quoted(c) for c in df.columns], *[F.expr(_places(f"__h_{n}", f"__p_{n}")).alias(f"__{n}") for n in patterns])


def base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """df with __spans: array<struct<k, s, e, hit, before, after>>, by kind and then start, and __token: other identifier-like strings."""
    text = quoted(text_col)
    digit = text.rlike("[0-9]")
    gates = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+") & digit, "token": digit | text.contains("@")}
    cut = _matches(df, text_col, PATTERNS | {"token": TOKEN}, gates)
    kinds = [f"transform(filter(__{kind}, x -> {VALID[kind]}), x -> struct({k} AS k, x.s AS s, x.e AS e, x.hit AS hit, x.before AS before, x.after AS after))" for k, kind in enumerate(KINDS)]
    spans = cut.withColumn("__spans", F.expr(f"concat({', '.join(kinds)})"))
    return spans.drop(*[f"__{k}" for k in KINDS])


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _patterns(before: str, after: str) -> str:
    """SQL: the lexical patterns of a mention between these texts, as an array of strings; a line's start and end are the word \n."""
    left = rf"filter(split(regexp_replace(lower({before}), r'(?s)^.*[\n\r]', ' \n '), r'[ \t\x0B\f]+'), w -> w != '')"
    right = rf"filter(split(regexp_replace(lower({after}), r'(?s)[\n\r].*$', ' \n '), r'[ \t\x0B\f]+'), w -> w != '')"
    return f"""filter(transform(array(struct({left} AS l, {right} AS r)), x -> array(
      IF(size(x.l) > 1, concat('L2 ', array_join(slice(x.l, -2, 2), ' ')), NULL),
      IF(size(x.l) > 0 AND element_at(x.l, -1) != char(10), concat('L1 ', element_at(x.l, -1)), NULL),
      IF(size(x.r) > 1, concat('R2 ', array_join(slice(x.r, 1, 2), ' ')), NULL),
      IF(size(x.l) > 0 AND size(x.r) > 0 AND NOT (element_at(x.l, -1) = char(10) AND x.r[0] = char(10)), concat('T ', element_at(x.l, -1), ' _ ', x.r[0]), NULL)))[0], p -> p IS NOT NULL)"""


def _scan(df: DataFrame, text_col: str, keep_text: bool = False) -> DataFrame:
    """df, without its text unless kept, with __rid, __spans (k, s, e) and __mentions (what the graph needs of each identifier); written."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rest = [c for c in df.columns if keep_text or c != text_col]
    work = base_spans(df.select(*[quoted(c) for c in rest], text.alias("__text")), "__text")
    # spans in blocks of about the square root of their number, so that no token is held against each of many spans
    width = "CAST(ceil(sqrt(size(__spans))) AS INT)"
    parts = f"IF(size(__spans) = 0, array(), transform(sequence(0, CAST(ceil(size(__spans) / {width}) AS INT) - 1), b -> slice(__spans, b * {width} + 1, {width})))"
    work = work.withColumn("__blocks", F.expr(f"transform({parts}, p -> struct(array_min(p.s) AS s, array_max(p.e) AS e, p))"))
    # bound by a lambda, or the optimizer would make the blocks anew for each token
    kept = """transform(array(__blocks), blocks -> filter(transform(__token, x -> struct(x.s AS s, x.s + length(rtrim('._%+-', x.hit)) AS e, rtrim('._%+-', x.hit) AS hit, x.before AS before,
      concat(substring(x.hit, length(rtrim('._%+-', x.hit)) + 1), x.after) AS after)), x -> NOT exists(blocks, b -> b.s < x.e AND x.s < b.e AND exists(b.p, y -> y.s < x.e AND x.s < y.e))))[0]"""
    digits = "regexp_replace(x.hit, '[^0-9]', '')"
    form = f"CASE WHEN x.hit RLIKE '[A-Za-z@]' OR {{k}} = {KINDS.index('ip')} THEN lower(x.hit) WHEN length({digits}) >= 7 THEN {digits} END"
    mention = f"struct(x.s AS s, x.e AS e, {{k}} AS k, {_patterns('x.before', 'x.after')} AS patterns, {form} AS instance)"
    mentions = f"filter(concat(transform(__spans, x -> {mention.format(k='x.k')}), transform({kept}, x -> {mention.format(k='-1')})), x -> size(x.patterns) > 0 AND x.instance IS NOT NULL)"
    made = work.select(*[quoted(c) for c in rest], F.monotonically_increasing_id().alias("__rid"), F.expr("transform(__spans, x -> struct(x.k AS k, x.s AS s, x.e AS e))").alias("__spans"), F.expr(mentions).alias("__mentions"))
    return written(made, "scanned")


def reliable_patterns(mentions: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, form, k, reliability) of the patterns that find. `mentions` has rows (k or -1, pattern, form, instance)."""
    edges = mentions.groupBy("pattern", "form", "instance").agg(F.collect_set(F.when(F.col("k") >= 0, F.col("k"))).alias("kinds"))
    seeded = edges.select("pattern", "form", F.explode("kinds").alias("k")).groupBy("pattern", "form", "k").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    seeded = written(seeded, "seeded")
    edges = written(edges.join(seeded.select("pattern", "form").distinct(), ["pattern", "form"], "left_semi"), "edges")
    sizes = edges.groupBy("pattern", "form").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.select("instance", F.explode("kinds").alias("k")).distinct()
    scores = seeds.withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        known = edges.select("pattern", "form", "instance").join(scores, "instance").groupBy("pattern", "form", "k").agg(F.sum("score").alias("known"))
        patterns = known.join(seeded, ["pattern", "form", "k"]).join(sizes, ["pattern", "form"]).select("pattern", "form", "k", (F.col("known") / (F.col("n") + 1)).alias("reliability"))
        patterns = written(patterns, "patterns")
        lent = edges.select("pattern", "form", "instance").join(patterns.filter(F.col("reliability") >= BELIEVED), ["pattern", "form"])
        lent = lent.groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("reliability"))))).alias("score"))
        scores = seeds.withColumn("score", F.lit(1.0)).unionByName(lent).groupBy("instance", "k").agg(F.max("score").alias("score"))
    return patterns.filter(F.col("reliability") >= FINDS)


def _found(scanned: DataFrame) -> DataFrame:
    """(__rid, x: struct<k, s, e>) of each span that reliable patterns find, of the kind of the most reliable one."""
    form = F.when(F.col("m.instance").contains("@"), "address").otherwise("number")
    mentions = scanned.select("__rid", F.explode("__mentions").alias("m")).select("__rid", "m.s", "m.e", "m.k", F.explode("m.patterns").alias("pattern"), form.alias("form"), "m.instance")
    mentions = written(mentions, "mentions")
    best = reliable_patterns(mentions).groupBy("pattern", "form").agg(F.max(F.struct("reliability", (-F.col("k")).alias("k"))).alias("best"))
    hits = mentions.filter("k < 0").join(best, ["pattern", "form"]).groupBy("__rid", "s", "e").agg(F.max("best").alias("best"))
    return written(hits.select("__rid", F.struct((-F.col("best.k")).alias("k"), "s", "e").alias("x")), "found")


def _joined(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows with __found; a few spans go to all tasks, so that the rows need no shuffle."""
    few = hits.limit(SENT_SPANS + 1).count() <= SENT_SPANS
    found = hits.groupBy("__rid").agg(F.array_sort(F.collect_list("x")).alias("__found"))
    return rows.join(F.broadcast(found) if few else found.hint("merge"), "__rid", "left").withColumn("__found", F.coalesce("__found", F.array().cast(found.schema["__found"].dataType)))


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without `text_col`, with base_spans and spans: array<struct<k, s, e>> (kind of KINDS, code points, end exclusive).

    Base spans are those of the base patterns, leftmost and without overlap for each kind; spans adds
    what context finds, which never overlaps a base span. Null texts count as empty. Repeated rows
    get equal answers, an empty table gives no rows, input columns with the names of the outputs, in
    any case, are replaced. A text without identifiers, or a corpus whose patterns have too few seeds, has base spans only.
    Very long texts are searched whole, each by one task; of the text on either side of a mention the patterns see CONTEXT characters, so
    that a word of more than that counts by its nearest part.
    """
    base = without(df, ["base_spans", "spans"])
    rest = [i for i, c in enumerate(base.columns) if c.lower() != text_col.lower()]
    scanned = _scan(_numbered_columns(base), _place(base, text_col))
    both = _joined(scanned, _found(scanned))
    return both.select(*[F.col(f"c{i}").alias(base.columns[i]) for i in rest], F.col("__spans").alias("base_spans"), F.array_sort(F.concat("__spans", "__found")).alias("spans"))


def _numbered_columns(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on, which clash with none that are added."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _place(df: DataFrame, name: str) -> str:
    return f"c{[c.lower() for c in df.columns].index(name.lower())}"


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span that `find` finds in `text_col` replaced by [KIND]; overlapping spans become one, by the first's kind.

    Null texts stay null; the other columns stay as they are, whatever their names. The texts are scanned once. Repeated rows are masked
    alike, an empty table gives no rows, and very long texts are masked whole.
    """
    text_at = _place(df, text_col)
    scanned = _scan(_numbered_columns(df), text_at, keep_text=True)
    both = _joined(scanned, _found(scanned))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.expr("array_sort(transform(concat(__spans, __found), x -> struct(x.s AS s, x.e AS e, x.k AS k)))")
    text = both.withColumn("__all", spans).withColumn("__names", names).withColumn("__raw", F.coalesce(text_at, F.lit(""))).withColumn(
        "__text",
        F.expr("""CASE WHEN size(__all) = 0 THEN __raw ELSE aggregate(__all, struct(0 AS at, CAST(array() AS array<string>) AS parts),
        (a, x) -> struct(greatest(a.at, x.e) AS at, IF(x.s < a.at, a.parts, concat(a.parts, array(substring(__raw, a.at + 1, x.s - a.at), __names[x.k]))) AS parts),
        a -> array_join(array_append(a.parts, substring(__raw, a.at + 1, length(__raw))), '')) END"""),
    )
    masked = F.when(F.col(text_at).isNotNull(), F.col("__text"))
    return text.select(*[(masked if f"c{i}" == text_at else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)])
