"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, names and units turn into typed placeholders, wherever they stand, so that a copy's
template is the item's own. A number is a run of digits with the points and commas inside it (1,250 and 3.5 are one slot
each), or a number word. A unit is a word of a fixed list. A name is a word with a capital first letter, unless the
benchmark uses it with and without: such words (How, The, Wenn) open sentences and stay words. Windows of five template
words are hashed. An item leaks into a document that holds 0.8 or more of the item's distinct windows and fills its slots
consistently: equal values of the item stand for equal values of the document, so a question with new numbers, names or
units is found too.

Each item is looked up by its rarest windows only, one more than a leak may miss, so at least one of them is in every
leaking document, and windows that many items share (as of placeholders alone) seldom join. Pairs so found are then
checked on all windows, once for each different text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, read, text_key
from .quality_rules import bind

WIDTH, SHARE, AGREEMENT = 5, 0.8, 0.8
#: Windows to look up that are broadcast at most, 16 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Marks a placeholder; a private-use character, taken out of texts first.
MARK = "\ue000"
#: Units, and words that count as numbers, in English, German, French and Spanish.
UNITS = (
    "km kg cm mm mg ml m g s h min hour hours minute minutes second seconds day days week weeks month months year years mile miles feet inches "
    "meter meters metre metres liter liters litre litres pound pounds dollar dollars euro euros cent cents percent "
    "stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren meile meilen kilometer kilogramm gramm prozent "
    "heure heures seconde secondes jour jours semaine semaines mois an ans kilomètre kilomètres mètre mètres gramme grammes"
    "hora horas minuto minutos segundo segundos día días semana semanas mes meses año años kilómetro kilómetros metro metros gramo gramos litro litros"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice double "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil"
).split()


def tokens(text: Column) -> Column:
    """Words in lower case, those with a capital first letter (of two or more) behind MARK, and numbers; digits and letters
    that touch part."""
    body = F.translate(F.coalesce(text, F.lit("")), MARK, "")
    marked = F.regexp_replace(body, r"(?<!\p{L})(?=\p{Lu}\p{L})", MARK)
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{MARK}?\p{{L}}+|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*"), F.lit(0))


def both_ways(benchmark: DataFrame) -> list[str]:
    """Words that the benchmark's texts use with a capital first letter and without, sorted: words that open sentences,
    whose number grows far slower than the benchmark."""
    used = benchmark.select(F.explode(tokens(F.col("text"))).alias("w")).select(F.translate("w", MARK, "").alias("w"), F.col("w").startswith(MARK).alias("big"))
    return [r.w for r in used.groupBy("w").agg(F.min("big").alias("low"), F.max("big").alias("high")).filter("low != high").orderBy("w").collect()]


def template(words: Column, plain: list[str] = ()) -> Column:
    """The words, slots replaced by their kind: MARK and n, p or u. plain: words that are no names (both_ways())."""
    small = lambda w, name: F.when(w.isin(NUMBERS), MARK + "n").when(w.isin(UNITS), MARK + "u").otherwise(name)
    big = lambda w: small(w, F.when(w.isin(list(plain)), w).otherwise(MARK + "p"))
    kind = lambda w: F.when(w.startswith(MARK), big(F.substr(w, F.lit(2)))).when(w.rlike(r"^\p{Nd}"), MARK + "n").otherwise(small(w, w))
    return F.transform(words, kind)


def windows(words: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of all windows, in order; none in a text with fewer words."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return bind(words, lambda w: F.when(F.size(w) >= width, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def text_windows(text: Column, plain: list[str] = (), width: int = WIDTH) -> Column:
    return bind(tokens(text), lambda w: windows(template(w, plain), width))


def item_windows(benchmark: DataFrame, plain: list[str] = (), width: int = WIDTH) -> DataFrame:
    """item_id, its words, template words and windows. Items of one id keep apart by their text. Items with fewer words
    than a window have none and never leak."""
    split = benchmark.dropDuplicates(["item_id", "text"]).select("item_id", tokens(F.col("text")).alias("i_words"))
    out = split.withColumn("i_template", template(F.col("i_words"), plain))
    return out.withColumn("i_windows", windows(F.col("i_template"), width)).filter(F.size("i_windows") > 0)


def probes(items: DataFrame, share: float = SHARE) -> DataFrame:
    """(hash, item): of each item's distinct windows the rarest, one more than a leak may lack."""
    flat = items.select("_item", F.explode(F.array_distinct("i_windows")).alias("hash"))
    rare = flat.groupBy("hash").agg(F.count("*").alias("_df"))
    of = Window.partitionBy("_item")  # a window over one item's text
    rank = F.row_number().over(of.orderBy("_df", "hash"))
    return flat.join(rare, "hash").select("hash", "_item", rank.alias("_rank"), F.count("*").over(of).alias("_n")).filter(F.col("_rank") <= F.col("_n") - F.ceil(F.col("_n") * share) + 1).select("hash", "_item")


def alignments(found: DataFrame, share: float = SHARE) -> DataFrame:
    """pair, anchor, i, offset: where the windows i of an item stand in the document, at i + offset, in each alignment.

    An alignment is an offset (place in the document minus place in the item) at which a share of the item's windows or
    more match, or the offset that most match at, the first of equal ones. A window that isn't there takes its place
    that is nearest, so words put in or left out of a copy don't count against it."""
    of_item = found.select("pair", F.posexplode("i_windows").alias("i", "hash"))
    matches = durable(of_item.join(found.select("pair", F.posexplode("windows").alias("p", "hash")), ["pair", "hash"]).select("pair", "i", (F.col("p") - F.col("i")).alias("offset")), "matches")
    cover = durable(matches.groupBy("pair", "offset").agg(F.count("*").alias("n")), "offsets")
    most = cover.groupBy("pair").agg(F.max(F.struct("n", (-F.col("offset")).alias("minus"))).alias("top")).select("pair", (-F.col("top.minus")).alias("anchor"))
    wide = cover.join(found.select("pair", F.size("i_windows").alias("all")), "pair").filter(F.col("n") >= F.col("all") * share).select("pair", F.col("offset").alias("anchor"))
    anchors = durable(wide.unionAll(most).distinct(), "anchors")
    there = matches.join(anchors.withColumn("offset", F.col("anchor")), ["pair", "offset"]).select("pair", "anchor", "i", "offset")
    absent = anchors.join(matches.select("pair", "i").distinct(), "pair").join(there.select("pair", "anchor", "i"), ["pair", "anchor", "i"], "left_anti")
    # each absent window looks one way and the other along the places of its window, sorted: no place meets all others
    line = absent.select("pair", "i", "anchor", F.col("anchor").alias("at"), F.lit(None).cast("int").alias("offset")).unionAll(matches.select("pair", "i", F.lit(None).cast("int"), "offset", "offset"))
    along = Window.partitionBy("pair", "i").orderBy("at")
    lower = F.last("offset", ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    upper = F.first("offset", ignorenulls=True).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = line.select("pair", "anchor", "i", lower.alias("lower"), upper.alias("upper")).filter("anchor is not null")
    near = F.when(F.col("upper").isNull() | (F.col("anchor") - F.col("lower") <= F.col("upper") - F.col("anchor")), F.col("lower")).otherwise(F.col("upper"))
    nearest = seen.select("pair", "anchor", "i", near.alias("offset"))
    return there.unionAll(nearest)


def agreements(found: DataFrame, share: float = SHARE) -> DataFrame:
    """pair, agreement: the share of an item's slot values that stand for one value of the document wherever a window
    covers them, in the alignment where it is largest; no row without slots."""
    # A word of the item stands where the window nearest to the alignment puts it; windows that a copy lacks may match far off.
    near = F.min(F.struct(F.abs(F.col("offset") - F.col("anchor")), "offset")).alias("least")
    covered = alignments(found, share).withColumn("j", F.explode(F.sequence("i", F.col("i") + (WIDTH - 1)))).groupBy("pair", "anchor", "j").agg(near).select("pair", "anchor", "j", "least.offset")
    slots = found.select("pair", F.posexplode(F.arrays_zip("i_template", "i_words")).alias("j", "at")).select("pair", "j", F.col("at.i_template").alias("kind"), F.col("at.i_words").alias("item")).filter(F.col("kind").startswith(MARK))
    words = found.select("pair", F.posexplode("words").alias("place", "doc"))
    filled = covered.join(slots, ["pair", "j"]).withColumn("place", F.col("j") + F.col("offset")).join(words, ["pair", "place"])
    value = F.struct("kind", "doc")
    single = filled.groupBy("pair", "anchor", "item").agg((F.min(value) == F.max(value)).cast("int").alias("one"))
    return single.groupBy("pair", "anchor").agg((F.sum("one") / F.count("*")).alias("agreement")).groupBy("pair").agg(F.max("agreement").alias("agreement"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, agree: float = AGREEMENT) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, text_key, item_id, n_matched and n_windows
    (distinct windows), coverage, agreement.

    docs: doc_id, text; benchmark: item_id, text; other columns are dropped. A null text counts as empty, and nothing
    leaks into an empty one. Rows that repeat a document's id and text give one row together, and so do an item's
    repeated rows. An empty table on either side gives an empty result."""
    plain = both_ways(benchmark)
    items = durable(item_windows(benchmark, plain).withColumn("_item", F.monotonically_increasing_id()), "items")
    probe = durable(probes(items, share), "probes")
    if probe.count() <= BROADCAST_ROWS:
        probe = F.broadcast(probe)
    keyed = docs.select("doc_id", text_key("text").alias("text_key"), F.col("text").alias("_text"))
    exploded = keyed.select("text_key", F.explode(text_windows(F.col("_text"), plain)).alias("hash"))
    pairs = durable(exploded.join(probe, "hash").select("text_key", "_item").distinct(), "pairs")
    hits = durable(keyed.join(durable(pairs.select("text_key").distinct(), "texts"), "text_key", "left_semi"), "hits")
    split = hits.select("text_key", "_text").dropDuplicates(["text_key"]).select("text_key", tokens(F.col("_text")).alias("words"))
    spread = durable(split.withColumn("windows", windows(template(F.col("words"), plain))), "windows")
    matched = F.size(F.array_intersect("windows", "i_windows")).cast("long").alias("n_matched")
    total = F.size(F.array_distinct("i_windows")).cast("long").alias("n_windows")
    both = pairs.join(spread, "text_key").join(items, "_item").select("*", matched, total).filter(F.col("n_matched") >= F.col("n_windows") * share)
    found = durable(both.withColumn("pair", F.monotonically_increasing_id()), "found")
    judged = found.join(agreements(found, share), "pair", "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).filter(F.col("agreement") >= agree)
    leaked = durable(judged.select("text_key", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "agreement"), "leaked")
    return hits.select("doc_id", "text_key").distinct().join(leaked, "text_key").select("doc_id", "text_key", "item_id", "n_matched", "n_windows", "coverage", "agreement").distinct()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that benchmark items leak into."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_matched", "n_windows", "coverage", "agreement")
