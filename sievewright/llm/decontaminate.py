"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and numbers in lower case. Each item has windows of W words, W following
from its length; each window has a 64-bit SimHash, the bitwise majority of its words' hashes, counted
in bit planes. Documents are cut into windows of the same sizes, each W words. Two fingerprints at
most RADIUS bits apart agree in one of RADIUS + 1 blocks of 16 bits, so a join on blocks finds every
pair within the radius. Each pair fixes where the item would lie in the document; there, and at all
places less than the item's length away where they share a 5-word shingle, as many words as the item
has are compared with it by exact weighted 5-word shingles (weight: how often), and places with a
similarity of 0.8 or more are reported.

A SimHash of a window as long as the item gives no such guarantee: one changed word in fifty moves
more bits than a radius can take that still parts texts. So W is the largest size for which a place
with at least that similarity has a whole document window without any change (see window_size), whose
fingerprint is an item window's own; no place is missed. Of items of up to eight words such a place
has all shingles, and their windows are shingles (or, if shorter, the item), at every word of a document.

Only the benchmark's fingerprints are broadcast, and only when they are counted and few; otherwise
the same join shuffles. A document's words are cut once, whatever the number of its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 3
BLOCK_BITS = 16
SHINGLE = 5
CHUNK = 16
#: Rows of fingerprints (some 40 bytes each) that are still broadcast.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and numbers in lower case; an empty array for none or a null."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


#: Window sizes of short items; such windows begin at every word and their mark is a plain hash.
SHORT = (1, 2, 3, 4, 5)


def window_kind(n: Column) -> Column:
    """The windows of an item of n words: 16, 8 or 4 words long, or SHORT[k] for kind -SHORT[k].

    With N = n - 4 shingles in the item and M in the place (fewer where a document's end cuts it),
    at most (5M - 4N) / 9 of the place's shingles are not the item's. A foreign word at an end costs
    one of them, a break within the place (a word left out, a jump) at least four. Words with j breaks
    hold a window for certain if there are (j + 2)W - 1 of them; the fewest are 4 + (36j + 4N) / 5,
    and N is 36j or more. So 16 needs n >= 48, which a break decides; 8 needs n >= 17 and 4 needs
    n >= 7, which a place that lost a fifth to the document's end decides. Up to n = 8 nothing may be
    lost, so a place has all the item's shingles.
    """
    return F.when(n >= 48, 16).when(n >= 17, 8).when(n >= 9, 4).otherwise(-F.least(n, F.lit(SHINGLE)))


def _add(df: DataFrame, a: list[str], b: list[str], out: str) -> tuple[DataFrame, list[str]]:
    """Sum of two counters held in bit planes, as columns, carry by carry."""
    names, carry = [], None
    for k, (x, y) in enumerate(zip(a, b)):
        one, two = F.col(x), F.col(y)
        half = f"{out}_h{k}"
        df = df.withColumn(half, one.bitwiseXOR(two))
        total, both = F.col(half), one.bitwiseAND(two)
        if carry:
            total, both = total.bitwiseXOR(F.col(carry)), both.bitwiseOR(F.col(half).bitwiseAND(F.col(carry)))
        df = df.withColumns({f"{out}_s{k}": total, f"{out}_c{k}": both})
        names.append(f"{out}_s{k}")
        carry = f"{out}_c{k}"
    return df, [*names, carry]


def _majority(planes: list[str]) -> Column:
    """Bits set in more than half of 2**(len(planes) - 1) words."""
    low = None
    for p in planes[:-2]:
        low = F.col(p) if low is None else low.bitwiseOR(F.col(p))
    return F.col(planes[-1]).bitwiseOR(F.col(planes[-2]).bitwiseAND(low))


def fingerprints(df: DataFrame, kinds: list[int]) -> tuple[DataFrame, dict[int, list[tuple[int, str]]]]:
    """Marks of the windows that begin in words[at : at + CHUNK] (columns words, at), by kind.

    Also the (offset, column) of each kind's windows.
    """
    keep, sizes = df.columns, [k for k in kinds if k > 0]
    planes = {}
    if sizes:
        df = df.withColumns({f"w{k}": F.xxhash64(F.get("words", F.col("at") + k)) for k in range(CHUNK)})
        planes = {(1, k): [f"w{k}"] for k in range(CHUNK)}
    size = 1
    while size < max(sizes, default=0):
        for k in range(0, CHUNK, 2 * size):
            df, planes[2 * size, k] = _add(df, planes[size, k], planes[size, k + size], f"p{2 * size}_{k}")
        size *= 2
    found: dict[int, list[tuple[int, str]]] = {}
    marks = {}
    for w in kinds:
        for k in range(0, CHUNK, max(w, 1)):
            name = f"f{w}_{k}".replace("-", "s")
            marks[name] = _majority(planes[w, k]) if w > 0 else F.xxhash64(F.slice("words", F.col("at") + k + 1, -w))
            found.setdefault(w, []).append((k, name))
    return df.select(*keep, *(c.alias(n) for n, c in marks.items())), found


def _rows(kind: int, offset: Column, mark: Column) -> list[Column]:
    """A struct for each block of a fingerprint; `key` tells kind, block and its bits. Equal plain
    hashes agree in any block, so one does."""
    tag = kind if kind > 0 else 32 - kind
    return [F.struct((F.lit((tag * 8 + b) << BLOCK_BITS).cast("long") + F.shiftrightunsigned(mark, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))).alias("key"), offset.cast("int").alias("offset"), mark.alias("mark"), F.lit(kind).alias("kind")) for b in range(64 // BLOCK_BITS if kind > 0 else 1)]


def _shingles(words_col: str) -> Column:
    """The 5-word shingles in order; a shorter text is one shingle."""
    n = F.size(words_col)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(F.col(words_col), i, SHINGLE)))).when(n > 0, F.array(F.xxhash64(F.col(words_col))))


def _weighted(df: DataFrame, keys: list[str], words_col: str, weight: str) -> DataFrame:
    """Each row's shingles and how often it has them."""
    return df.select(*keys, F.explode(_shingles(words_col)).alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias(weight))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, shared, total, similarity: the best place of each item in
    each document (the first of equals) where it is similar enough.

    A place is as long as the item, cut at the document's ends. Null and empty texts have no words
    and match nothing; ids that are null or repeat: as in `common`, for items too.
    """
    if similarity[0] * 5 < similarity[1] * 4:
        raise ValueError("windows are made for similarities of 0.8 and more")
    items = common.keyed(benchmark, item_col, item_text_col).select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("kind", window_kind(F.size("words")))
    items, _ = common.written(items, "items")
    kinds = sorted(r[0] for r in items.select("kind").distinct().collect())  # of 16, 8, 4 and SHORT
    pages = common.keyed(docs, id_col, text_col)
    if not kinds:
        return pages.join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", *(F.lit(0).cast("long").alias(c) for c in ("start_word", "n_words", "shared", "total")), F.lit(0.0).alias("similarity"))
    starts = items.select("item_id", F.col("kind").alias("own"), "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.abs("kind"))).alias("at"))
    marked, found = fingerprints(starts, kinds)
    blocks = [x for w in kinds for x in _rows(w, F.lit(0), F.col(found[w][0][1]))]
    known = marked.select("item_id", "at", "own", F.inline(F.array(*blocks))).where("kind = own").select("key", "item_id", F.col("at").alias("item_at"), F.col("mark").alias("item_mark"))
    known, _ = common.written(known, "fingerprints")
    chunks = pages.select("doc_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("n", F.size("words")).select("doc_id", "words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))).alias("at"))
    marked, found = fingerprints(chunks, kinds)
    blocks = [x for w in kinds for k, name in found[w] for x in _rows(w, F.lit(k), F.col(name))]
    windows = marked.select("doc_id", "n", "at", F.inline(F.array(*blocks))).where(F.col("at") + F.col("offset") + F.abs("kind") <= F.col("n"))
    right = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    near = windows.join(right, "key").where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= F.when(F.col("kind") > 0, RADIUS).otherwise(0))
    places = near.select("doc_id", "item_id", (F.col("at") + F.col("offset") - F.col("item_at")).alias("place")).distinct()
    places, _ = common.written(places, "places")

    lengths = items.select("item_id", F.size("words").alias("length"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    lists, _ = common.written(places.join(few(lengths), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", F.col("place").alias("near"), "length")).alias("found")), "places-of")
    # of all texts only those of documents with places are shuffled; their ids are broadcast if few
    ids = lists.select("doc_id")
    hit = pages.join(F.broadcast(ids) if lists.count() <= common.BROADCAST_IDS else ids, "doc_id", "left_semi")
    texts = hit.join(lists.hint("merge"), "doc_id").select("doc_id", words(F.col("text")).alias("words"), "found")
    length = F.col("length")
    wide = texts.select("doc_id", "words", F.inline("found")).withColumn("low", F.greatest(F.col("near") - length + 1, F.lit(0)))
    wide = wide.select("doc_id", "item_id", "near", "length", "low", F.slice("words", F.col("low") + 1, F.col("near") + 2 * length - 1 - F.col("low")).alias("wide"))
    wide, _ = common.written(wide, "passages")
    # a window beyond a break lies at another place than the best one, so all places of shared shingles are compared
    known = items.select("item_id", F.posexplode(_shingles("words")).alias("item_at", "shingle"))
    aligned = wide.select("doc_id", "item_id", "near", "length", "low", F.posexplode(_shingles("wide")).alias("at", "shingle")).join(few(known), ["item_id", "shingle"]).withColumn("place", F.col("at") + F.col("low") - F.col("item_at"))
    aligned = aligned.where(F.abs(F.col("place") - F.col("near")) < length).select("doc_id", "item_id", "place", "near").unionByName(wide.select("doc_id", "item_id", F.col("near").alias("place"), "near"))
    aligned = aligned.groupBy("doc_id", "item_id", "place").agg(F.min("near").alias("near"))
    begin = F.greatest(F.col("place"), F.lit(0))
    cut = aligned.join(wide, ["doc_id", "item_id", "near"]).select("doc_id", "item_id", "place", F.slice("wide", begin - F.col("low") + 1, length + F.col("place") - begin).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    here = _weighted(cut, ["doc_id", "item_id", "place", "n_words"], "words", "here")
    there = _weighted(items, ["item_id"], "words", "there")
    weights = there.groupBy("item_id").agg(F.sum("there").alias("item_weight"))
    shared = here.join(there, ["item_id", "shingle"], "left").groupBy("doc_id", "item_id", "place", "n_words").agg(F.sum("here").alias("own_weight"), F.sum(F.least("here", F.coalesce("there", F.lit(0)))).alias("shared")).join(weights, "item_id").withColumn("total", F.col("own_weight") + F.col("item_weight") - F.col("shared"))
    enough = shared.where(F.col("shared") * similarity[1] >= F.col("total") * similarity[0])
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("place")).alias("back"), "n_words", "shared", "total")).alias("b"))
    return best.select(common.id_out(), common.id_out("item_id"), F.greatest(-F.col("b.back"), F.lit(0)).cast("long").alias("start_word"), "b.n_words", "b.shared", "b.total", "b.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose document has no leak, with all their columns."""
    leaks, _ = common.written(find_leaks(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct(), "leaks")
    return common.without(docs, leaks, id_col)


def oracle(docs: str = "documents", text: str = "text", name: str = "leaks") -> str:
    """DuckDB: common table expressions that end in `name`, by brute force over shared shingles."""
    cut = "list_filter(string_split_regex(lower(coalesce(TEXT, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    sh = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""dw AS (SELECT doc_id, {cut.replace('TEXT', text)} AS w FROM {docs}),
      iw AS (SELECT item_id, {cut.replace('TEXT', 'text')} AS w FROM benchmark),
      ds AS (SELECT doc_id, unnest(s) AS sh, generate_subscripts(s, 1) AS p FROM (SELECT doc_id, {sh} AS s FROM dw)),
      its AS (SELECT item_id, unnest(s) AS sh, generate_subscripts(s, 1) AS p FROM (SELECT item_id, {sh} AS s FROM iw)),
      al AS (SELECT DISTINCT doc_id, item_id, ds.p - its.p AS place FROM ds JOIN its USING (sh)),
      reg AS (SELECT doc_id, item_id, place, dw.w[greatest(place, 0) + 1 : place + len(iw.w)] AS w FROM al JOIN dw USING (doc_id) JOIN iw USING (item_id)),
      rs AS (SELECT doc_id, item_id, place, len(w) AS n_words, unnest({sh}) AS sh FROM reg),
      rc AS (SELECT doc_id, item_id, place, n_words, sh, count(*) AS here FROM rs GROUP BY ALL),
      ic AS (SELECT item_id, sh, count(*) AS there FROM its GROUP BY ALL),
      wt AS (SELECT item_id, sum(there) AS item_weight FROM ic GROUP BY ALL),
      sc AS (SELECT doc_id, item_id, place, n_words, sum(here) AS own, sum(least(here, coalesce(there, 0))) AS shared FROM rc LEFT JOIN ic USING (item_id, sh) GROUP BY ALL),
      ok AS (SELECT doc_id, item_id, place, n_words, shared, own + item_weight - shared AS total FROM sc JOIN wt USING (item_id)),
      {name} AS (SELECT doc_id, item_id, CAST(greatest(place, 0) AS BIGINT) AS start_word, CAST(n_words AS BIGINT) AS n_words, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total, CAST(shared AS DOUBLE) / CAST(total AS DOUBLE) AS similarity
        FROM ok WHERE shared * 100 >= total * 80
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, place) = 1)"""
