"""Projections and filters that ready catalogues and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import bound

#: Pieces of a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def normalize_label(label: Column) -> Column:
    return F.when(label == "normal", "good").otherwise("bad")


def plan_layout(df: DataFrame, root: str, mode: str = "1cls") -> DataFrame:
    """Destination of each image, and of those masks that the mode keeps:
    one-class keeps masks of bad test images, two-class of all bad ones.

    df: (object, split, label, image, mask)."""
    label, name = normalize_label(F.col("label")), lambda c: F.element_at(F.split(c, "/"), -1)
    keep = (label == "bad") & ((F.col("split") == "test") if mode == "1cls" else F.lit(True))
    to = lambda kind, c: F.concat_ws("/", F.lit(root), "object", kind, label, name(c))
    return df.select("object", "split", label.alias("label"), F.col("image").alias("src"), to(F.col("split"), F.col("image")).alias("dst"), F.when(keep, F.col("mask")).alias("mask_src"), F.when(keep, to(F.lit("ground_truth"), F.col("mask"))).alias("mask_dst"))


def binarize(value: Column, tau: float = 0.0, hi: int = 255) -> Column:
    return F.when(value > tau, hi).otherwise(0)


def pair_masks(images: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Each image with its mask, by key; ``unpaired`` lists what lacks one."""
    return images.join(masks, keys, "left")


def unpaired(images: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    return images.join(masks, keys, "left_anti")


def restrict_classes(df: DataFrame, classes: DataFrame, by: str) -> DataFrame:
    return df.join(classes, by, "left_semi")


def unknown_classes(df: DataFrame, classes: DataFrame, by: str) -> DataFrame:
    return df.select(by).distinct().join(classes, by, "left_anti")


def compose_name(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def parse_name(name: Column) -> Column:
    """array of three parts; null if there are not three."""
    parts = F.split(name, "-", -1)
    return F.when(F.size(parts) == 3, parts)


def display_name(df: DataFrame, aliases: DataFrame, by: str) -> DataFrame:
    """aliases: (``by``, display), such as ``prompts.aliases``; a name
    without one is its own."""
    return df.join(aliases, by, "left").withColumn("display", F.coalesce("display", by))


def standardize(values: Column, means: list[float], stds: list[float]) -> Column:
    m = F.array(*[F.struct(F.lit(a).alias("m"), F.lit(b).alias("s")) for a, b in zip(means, stds, strict=True)])
    return F.zip_with(values, m, lambda v, c: (v / 255.0 - c["m"]) / c["s"])


def destandardize(values: Column, means: list[float], stds: list[float]) -> Column:
    """Back to whole numbers in 0..255 (cut, then clamped)."""
    m = F.array(*[F.struct(F.lit(a).alias("m"), F.lit(b).alias("s")) for a, b in zip(means, stds, strict=True)])
    return F.zip_with(values, m, lambda v, c: F.least(F.lit(255), F.greatest(F.lit(0), ((v * c["s"] + c["m"]) * 255.0).cast("int"))))


def unescaped(text: Column) -> Column:
    """Character references as HTML 5 reads them: all names, the old ones
    without a semicolon too, and numbers of any plane.

    The text is bound once and cut at its references in one pass; texts
    without an ampersand are left as they are.
    """
    import json
    from html.entities import html5

    # windows-1252 for 128 to 159, as browsers have it; other control
    # characters and numbers that name no character are dropped or replaced
    odd = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)} | {0: "\ufffd", 13: "\r"}
    old = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
    constant = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")  # noqa: E731  folded to one literal
    names, odds = constant(html5), constant(odd)
    reference = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"

    def number(n: Column) -> Column:
        named = F.element_at(odds, n.cast("string"))
        none = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127) | n.between(0xFDD0, 0xFDEF) | ((n % 65536) >= 65534)
        bad = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return F.when(named.isNotNull(), named).when(bad, "\ufffd").when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(p: Column) -> Column:
        digits = lambda pattern: F.ltrim(F.regexp_extract(p, pattern, 1), F.lit("0"))
        hexes, decimals = digits(r"^&#[xX]([0-9a-fA-F]+);?$"), digits(r"^&#([0-9]+);?$")
        value = lambda d, base: F.when(F.length(d) > 9, 0x110000).otherwise(F.coalesce(F.conv(d, base, 10).cast("long"), F.lit(0)).cast("int"))
        body = F.substr(p, F.lit(2))
        head = F.regexp_extract(body, f"^({old})", 1)
        known = F.element_at(names, body)
        name = F.when(known.isNotNull(), known).when(head != "", F.concat(F.element_at(names, head), F.substr(body, F.length(head) + 1))).otherwise(p)
        return F.when(~p.startswith("&"), p).when(p.rlike("^&#[xX][0-9a-fA-F]"), number(value(hexes, 16))).when(p.rlike("^&#[0-9]"), number(value(decimals, 10))).otherwise(name)

    return bound(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(reference), F.lit(0)), one), "")).otherwise(t))


def clean_text(text: Column) -> Column:
    """Character references resolved twice, white space collapsed, trimmed,
    lower case."""
    twice = F.when(text.contains("&"), unescaped(unescaped(text))).otherwise(text)
    return F.lower(F.trim(F.regexp_replace(twice, r"\s+", " ")))


def pretokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def token_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(pretokenize(clean_text(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def read_subword_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """merges (rank, first, second) and vocab (id, token) of a public
    tokenizer's JSON file, which the driver reads (some 10**5 rows)."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "rank int, first string, second string")
    return merges, spark.createDataFrame([(i, t) for t, i in model["vocab"].items()], "id int, token string")


#: Words whose ids a task keeps.
MEMO = 1 << 18


def subword_lists(df: DataFrame, merges: DataFrame, vocab: DataFrame, words: str, as_bytes: bool = False) -> DataFrame:
    """``df`` with ``ids`` instead of ``words``, an array of words: the
    subword ids of a row's words in their order, none for a null array.
    Null and empty words have none.

    merges: (rank, first, second); vocab: (id, token).  Rows stay where they
    are; a word is merged once for each batch, and once for many batches
    while it is among a task's ``MEMO`` words.  The pairs of a word wait in a
    heap and its symbols in a linked list, so a word takes time in proportion
    to its length (times a logarithm).  ``as_bytes``: symbols are UTF-8
    bytes, each shown as a printable letter, as byte-level tables have them;
    otherwise letters.  Symbols that the vocabulary lacks have id -1.
    """
    import numpy as np
    import pyarrow as pa

    rank = {(r["first"], r["second"]): r["rank"] for r in merges.collect()}  # a tokenizer's tables: at most some 10**5 rows
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    shared = df.sparkSession.sparkContext.broadcast((rank, ids))
    others = [c for c in df.columns if c != words]

    def merged(symbols, rank):
        from heapq import heapify, heappop, heappush

        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(p)) is not None]
        heapify(heap)
        while heap:
            _, i, (a, b) = heappop(heap)
            j = after[i]
            if symbols[i] != a or j == n or symbols[j] != b:
                continue  # merged with another neighbour since
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank.get(pair := (symbols[left], symbols[after[left]]))) is not None:
                    heappush(heap, (r, left, pair))
        return [s for s in symbols if s is not None]

    def encode(batches):
        rank, ids = shared.value
        shown, free, known = {}, 256, {}
        for byte in range(256):  # bytes without a visible letter take those from 256 on
            visible = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
            shown[byte], free = (chr(byte), free) if visible else (chr(free), free + 1)
        for b in batches:
            lists = b.column(words)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode("encode")
            found = []
            for w in coded.dictionary.to_pylist():
                got = known.get(w)
                if got is None:
                    s = ([shown[x] for x in w.encode()] if as_bytes else list(w)) if w else []
                    if s:
                        s[-1] += "</w>"
                    got = np.array([ids.get(t, -1) for t in merged(s, rank)], dtype=np.int32)
                    if len(known) >= MEMO:
                        known.clear()
                    known[w] = got
                found.append(got)
            lengths = np.array([len(x) for x in found], dtype=np.int64)
            at = np.asarray(coded.indices)
            n = lengths[at] if len(at) else np.empty(0, dtype=np.int64)
            starts, ends = (np.cumsum(lengths) - lengths)[at] if len(at) else n, np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - starts, n)
            flat = np.concatenate([*found, np.empty(0, np.int32)])[place]
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), made], names=[*others, "ids"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others]
    return df.select(*others, words).mapInArrow(encode, ", ".join([*kinds, "ids array<int>"]))


def subword_encode(words: DataFrame, merges: DataFrame, vocab: DataFrame, key: str, word: str, as_bytes: bool = False) -> DataFrame:
    """Ids of the words of each key, in order of ``pos``, as ``subword_lists``
    makes them.  Keys without a word that is neither null nor empty go."""
    own = F.array_sort(F.collect_list(F.struct("pos", F.col(word).alias("word"))))
    lists = words.where(F.col(word) != "").groupBy(key).agg(F.transform(own, lambda s: s["word"]).alias("_words"))
    return subword_lists(lists, merges, vocab, "_words", as_bytes)


def ids_to_text(df: DataFrame, vocab: DataFrame, key: str, ids: str) -> DataFrame:
    """Tokens joined, word ends as blanks."""
    rows = df.select(key, F.posexplode(ids).alias("pos", "id")).join(vocab, "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), "")
    return rows.groupBy(key).agg(F.trim(F.replace(text, F.lit("</w>"), F.lit(" "))).alias("text"))


def frame_sequence(ids: Column, length: int, start: int, end: int) -> Column:
    """start, ids, end; cut to ``length`` with the end kept; padded with 0."""
    body = F.slice(ids, 1, length - 2)
    framed = F.concat(F.array(F.lit(start)), body, F.array(F.lit(end)))
    return F.concat(framed, F.array_repeat(F.lit(0), F.lit(length) - F.size(framed)))


def end_position(ids: Column) -> Column:
    """0-based place of the first largest id."""
    return F.array_position(ids, F.array_max(ids)) - 1


def valid_mask(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda i: i != pad)


def natural_key(text: Column, width: int = 20) -> Column:
    """Sort key under which numbers order by value."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(F.lower(p)))


def tag_catalog(df: DataFrame) -> DataFrame:
    """(model, tag) rows from (model, tags map), tags normalised."""
    return df.select("model", F.explode(F.map_keys("tags")).alias("tag")).withColumn("tag", F.replace(F.lower("tag"), F.lit("-"), F.lit("_")))


def by_tag(catalog: DataFrame, tag: str) -> DataFrame:
    """Models that have a tag, which is normalised as in the catalogue."""
    return catalog.where(F.col("tag") == tag.lower().replace("-", "_")).select("model").distinct()


def by_model(catalog: DataFrame, model: str) -> DataFrame:
    """Tags of a model."""
    return catalog.where(F.col("model") == model).select("tag").distinct()


def phase(df: DataFrame, name: str, split: str = "split") -> DataFrame:
    """Rows of one phase (``train``, ``test``); prunes folders where ``split``
    partitions the table."""
    return df.where(F.col(split) == name)


def fill_mask(mask: Column) -> Column:
    """Missing masks are zero."""
    return F.coalesce(mask, F.lit(0))
