"""Personal data by expressions and by bootstrapped contextual extraction.

Base spans come from four expressions with checks. They seed the bootstrap: the words around a span form lexical
patterns (two words before; one before and one after; a label, such as `phone:`). Candidates are other tokens with digits or an at sign, written
so that the expressions miss them; each has the kinds that its shape allows. A bipartite graph of patterns and instances
is scored in rounds of Spark joins and sums: a pattern is as good as the share of its instances that are seeds or likely
identifiers, smoothed against rare patterns; an instance is as good as its patterns are, taken together. Candidates whose
score passes the threshold become spans of the kind that the pattern stands for, wherever they occur, and seeds of the
next generation of patterns, until none is added. Of kinds with equal support the one listed first counts.

All searches in a text take time in proportion to its length, whatever its words are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, free_name, read

KINDS = ("email", "ip", "card", "phone")
#: The base expressions. An email is found from its at sign outwards, with the same result as
#: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`; the others can't start inside a run that failed before.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that may be identifiers, never a part of a longer one: seven digits or more, or an at sign spelled out or padded.
NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]{5,}[0-9](?![0-9A-Za-z])")
#: What stands between a label and its value.
LABEL = re.compile(r"[\x20\t\"'(]*([:=#])[\x20\t\"'(]*")
FOUR_PARTS = re.compile(r"[0-9]{1,3}(?:[^0-9]+[0-9]{1,3}){3}")
AT = re.compile(r"\x20?(?:\(at\)|\[at\]|@)\x20?")
AFTER_AT = re.compile(r"[\w-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[\w-]++)++")
WORD = re.compile(r"\w+")
#: Longer patterns are known by a digest of all their characters.
LONG = 100

ROUNDS, LEAST_SEEDS, LEAST_SHARE, ACCEPT = 3, 5, 0.5, 0.8


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def around_at(text: str, begin: int, end: int, marks: re.Pattern, before, after: re.Pattern) -> list[tuple[int, int]]:
    """Spans, in order and apart, of a run of characters that `before` accepts, a mark, and a match of `after`."""
    out, done = [], begin
    for m in marks.finditer(text, begin, end):
        at = m.start()
        while at > done and before(text[at - 1]):
            at -= 1
        if done <= at < m.start() and (found := after.match(text, m.end(), end)):
            out.append((at, found.end()))
            done = found.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, *x) for x in around_at(text, 0, len(text), re.compile("@"), LOCAL.__contains__, DOMAIN)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def shape(token: str) -> int:
    """The kinds that a number's shape allows, a bit for each."""
    n = len(digits(token))
    return 2 * bool(FOUR_PARTS.fullmatch(token)) + 4 * (12 <= n <= 19) + 8 * (7 <= n <= 15)


def candidates(text: str, begin: int, end: int) -> list[tuple[int, int, int]]:
    """(kinds, start, end) between two places; of tokens that overlap the first, then the longest."""
    found = [(*x, 1) for x in around_at(text, begin, end, AT, lambda c: c.isalnum() or c in "_.%+-", AFTER_AT)]
    found += [(*m.span(), kinds) for m in NUMBER.finditer(text, begin, end) if (kinds := shape(m.group()))]
    out, done = [], begin
    for s, e, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= done:
            out.append((kinds, s, e))
            done = e
    return out


def words_before(text: str, end: int, n: int) -> list[str]:
    """The last n words before a place, whole ones however long they are."""
    reach = 64
    while True:
        begin = max(0, end - reach)
        found = WORD.findall(text, begin, end)
        if not begin or len(found) > n:  # the first one found may be cut
            return found[-n:]
        reach *= 2


def words_after(text: str, begin: int, n: int) -> list[str]:
    reach = 64
    while True:
        end = min(len(text), begin + reach)
        found = WORD.findall(text, begin, end)
        if end == len(text) or len(found) > n:
            return found[:n]
        reach *= 2


def label(text: str, start: int) -> str:
    """The mark of a label right before a place: `:` in `phone: `; empty without one."""
    begin = start
    while begin and start - begin < 8 and not (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        begin -= 1
    found = LABEL.fullmatch(text, begin, start)
    return found[1] if found else ""


def context(text: str, start: int, end: int) -> list[str]:
    before = [w.lower() for w in words_before(text, start, 2)]
    after = [w.lower() for w in words_after(text, end, 1)]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before and (mark := label(text, start)):
        out.append(f"{before[-1]} {mark} _")
    return [p if len(p) <= LONG else hashlib.md5(p.encode()).hexdigest() for p in out]


def extracted(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans; and mentions: kind (-1: a candidate), the kinds a candidate may be, start, end, instance, patterns."""
    if not any(c in text for c in "0123456789@") and "(at)" not in text and "[at]" not in text:
        return [], []
    base = base_spans(text)
    mentions = [(k, 0, s, e) for k, s, e in base]
    at = 0
    for a, b in [*sorted((s, e) for _, s, e in base), (len(text), len(text))]:  # the gaps between base spans
        mentions += [(-1, *c) for c in candidates(text, at, a)] if at < a else []
        at = max(at, b)
    return base, [{"kind": k, "fits": f, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": context(text, s, e)} for k, f, s, e in mentions]


SPAN = "kind:int,start:int,end:int"
FOUND = f"struct<base:array<struct<{SPAN}>>,mentions:array<struct<kind:int,fits:int,start:int,end:int,instance:string,patterns:array<string>>>>"


def found_in(text: str) -> Column:
    """struct(base, mentions) of a text column; a null text counts as empty."""
    span = pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")])
    mention = pa.struct([(c, pa.int32()) for c in ("kind", "fits", "start", "end")] + [("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array) -> pa.Array:
        base, mentions = zip(*[extracted(x or "") for x in texts.to_pylist()], strict=True) if len(texts) else ((), ())
        base = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))], names=["base", "mentions"])

    return of(F.col(text))


def bootstrap(rows: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_share: float = LEAST_SHARE, accept: float = ACCEPT) -> DataFrame:
    """row, kind, start, end of candidates that the patterns confirm, wherever they stand. rows: row, mentions.

    Generations go on until one confirms nothing new: each takes what is confirmed so far for seeds, chooses the
    patterns again from all edges, and scores the other candidates in rounds. A pattern is used if at least
    least_seeds different seeds, and least_share of all its seeds, are of one kind. Tables that edges are joined to are
    written first, so that Spark can split a pattern or an instance that has many edges."""
    mention = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # What rows repeat counts once: an edge for each kind, instance and pattern.
    edges = durable(mention.select("kind", "fits", "instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    others = edges.filter("kind < 0").select("instance", "fits", "pattern")
    chosen = None
    while True:
        known = edges.filter("kind >= 0").select("pattern", "kind", "instance")
        if chosen is not None:
            known = known.unionAll(others.join(chosen, "instance").select("pattern", F.col("as_kind").alias("kind"), "instance"))
        seeds = known.distinct().groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
        main = seeds.groupBy("pattern").agg(F.max(F.struct("seeds", (-F.col("kind")).alias("minus"))).alias("top"), F.sum("seeds").alias("all"))
        usable = main.select("pattern", F.col("top.seeds").alias("seeds"), (-F.col("top.minus")).alias("as_kind"), "all").filter((F.col("seeds") >= least_seeds) & (F.col("seeds") >= least_share * F.col("all")))
        usable = durable(usable, "pii-patterns")  # most patterns stop here: few contexts recur
        open_edges = others.join(usable, "pattern").filter("shiftright(fits, as_kind) % 2 = 1").select("instance", "pattern", "as_kind", "seeds")
        if chosen is not None:
            open_edges = open_edges.join(chosen, ["instance", "as_kind"], "left_anti")
        open_edges = durable(open_edges, "pii-graph")
        score = open_edges.select("instance", "as_kind").distinct().withColumn("score", F.lit(0.0))
        for i in range(rounds):
            good = open_edges.join(score, ["instance", "as_kind"]).groupBy("pattern", "as_kind").agg(F.sum("score").alias("likely"), F.count("*").alias("others"), F.max("seeds").alias("seeds"))
            pattern = durable(good.select("pattern", "as_kind", ((F.col("seeds") + F.col("likely")) / (F.col("seeds") + F.col("others") + 1)).alias("p")), f"pii-weights-{i}")
            doubt = open_edges.join(pattern, ["pattern", "as_kind"]).groupBy("instance", "as_kind").agg(F.sum(F.log1p(-F.least("p", F.lit(0.999)))).alias("doubt"))
            score = durable(doubt.select("instance", "as_kind", (1 - F.exp("doubt")).alias("score")), f"pii-scores-{i}")
        best = score.groupBy("instance").agg(F.max(F.struct("score", (-F.col("as_kind")).alias("minus"))).alias("top")).filter(F.col("top.score") >= accept)
        new = best.select("instance", (-F.col("top.minus")).alias("as_kind"))
        new = durable(new if chosen is None else new.join(chosen, "instance", "left_anti"), "pii-confirmed")
        if new.isEmpty():
            break
        chosen = new if chosen is None else durable(chosen.unionAll(new), "pii-confirmed")
    confirmed = new if chosen is None else chosen
    return mention.filter("kind < 0").join(confirmed, "instance").select("row", F.col("as_kind").alias("kind"), "start", "end")


def grouped(new: DataFrame) -> DataFrame:
    """row, new: the confirmed spans of each row, as many as one text holds."""
    return durable(new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new")), "pii-new")


def every_span(base: str, new: str) -> Column:
    return F.sort_array(F.concat(base, F.coalesce(F.col(new), F.array().cast(f"array<struct<{SPAN}>>"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, base and spans (base and confirmed ones, by kind, then start) for every row of docs
    (doc_id, text; other columns are dropped). A null text counts as empty; rows with equal or null ids are kept apart; an
    empty table gives an empty result."""
    rows = durable(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found_in("text").alias("found")).select("row", "doc_id", "found.*"), "pii-rows")
    out = rows.select("row", "doc_id", "base").join(grouped(bootstrap(rows)), "row", "left")
    return out.select("row", "doc_id", "base", every_span("base", "new").alias("spans"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, all columns and rows kept. Spans that
    overlap are replaced together, under the kind of the first. n_chars, if there, becomes the length of a changed text. A null text
    stays null; an empty table gives an empty result.

    Base spans are found and used where a row lies; only rows with candidates are shuffled, to what became of these."""
    row, found, spans = (free_name(docs, c) for c in ("pii_row", "pii_found", "pii_spans"))

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for x, listed in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, parts = 0, []
            for s in sorted(listed or [], key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [x[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                at = max(at, s["end"])
            out.append(x if x is None else "".join([*parts, x[at:]]))
        return pa.array(out, pa.string())

    rows = durable(docs.withColumns({row: F.monotonically_increasing_id(), found: found_in(text)}), "pii-rows")
    new = grouped(bootstrap(rows.select(F.col(row).alias("row"), F.col(found)["mentions"].alias("mentions")))).withColumnsRenamed({"row": row, "new": spans})
    open_ = F.exists(F.col(found)["mentions"], lambda m: m["kind"] < 0)
    both = rows.filter(~open_).withColumn(spans, F.lit(None).cast(f"array<struct<{SPAN}>>")).unionByName(rows.filter(open_).join(new, row, "left"))
    all_ = both.withColumn(found, F.col(found)["base"])
    all_ = all_.withColumn(spans, every_span(found, spans))
    some = F.size(spans) > 0
    out = all_.withColumn(text, F.coalesce(masked(F.when(some, F.col(text)), F.when(some, F.col(spans))), F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = personal_data(read(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")  # noqa: E731  Spark takes a second parameter for the place
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))
