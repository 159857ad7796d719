"""Subject areas of each document by label propagation over a verified document-similarity graph.

The nodes are the distinct texts. Each is described by its phrases (words of spaced languages, character runs of the
others) that may tell a subject: labelled documents that hold the phrase mostly agree, or none is labelled. Minimum
hashes of those phrases gather documents in groups; large groups are split into stars of bounded size, and every member
is linked with the star's centre (a labelled document where there is one) once their exact Jaccard similarity is verified,
so the graph has a bounded number of links a document and no pairs within a group are made.

Labels that people gave are the seeds. Each round is a join of the links with the subjects of their ends: a document is
about the subjects that enough of its neighbours, weighed by similarity, are about, several at once. A seed is trusted
if its neighbours bear it out; trusted seeds are clamped in every round and in the result. Rounds go on until few
documents change.

What is asked for is the share of a document's sentences, so an exact count follows: a phrase stands for the subject
that is clearly ahead among the documents that hold it (none if two are level), a sentence belongs to its strongest
phrase, and a document is about every subject with at least a quarter of its sentences. The count is done once with the
subjects of the graph and once with those it gave.

Defined results: null and empty texts and texts without words have no subject; labels of unknown documents or with
null fields are ignored, repeated ones count once; without labels no document has a subject; texts of any length are
taken whole; copies of a text are one node, with the labels of all of them and the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import plain_table, sentences
from tessera.session import remove, scratch, stored

#: Share of a document's sentences from which it is about a subject.
SHARE = 0.25
#: Buckets that phrases are counted in before any is looked at by itself; a bit a bucket is sent to the workers.
BUCKETS = 1 << 20
#: Smoothed share of the leading subject among a bucket's labelled documents from which its phrases describe documents.
TELLING = 0.5
#: Minimum hashes of a document, documents of a star, and the Jaccard similarity from which a link is verified.
HASHES, STAR, SIMILAR = 8, 64, 0.2
#: Share of a document's neighbours that gives it a subject, and that bears a seed out.
HELD, BORNE = 0.35, 0.2
#: Share of changed documents at which rounds end, and the most rounds there are.
CHANGED, ROUNDS = 0.01, 12
#: Smoothed share of one subject among a phrase's documents from which the phrase stands for it, and how often the
#: sentences are counted (the second time with the subjects that the first found).
LINK_SHARE, COUNTS = 0.7, 2

_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"(?P<hangul>[가-힣]+)|(?P<kata>[ァ-ヺー]+)|(?P<han>[一-鿿㐀-䶿々]+)|(?P<latin>[^\W\d_ぁ-ヿ㐀-鿿가-힣]+)")
_MIXED = re.compile("(?=([一-鿿][ぁ-ゖ]{2}|[ぁ-ゖ]{2}[一-鿿]))")
_SPEAKER = re.compile(r"^\s*(?:[-*•]\s*|\d+\)\s*)?[^\s:：「]{1,20}\s*(?::\s|：|「)")


def phrases(sentence: str) -> set[str]:
    """The phrases of a sentence: words of spaced languages, katakana runs, Han pairs and triples, Han next to
    hiragana, and the heads of Korean words."""
    s = _SPEAKER.sub("", sentence).lower()
    out = set(_MIXED.findall(s))
    for m in _TOKEN.finditer(s):
        w, kind = m.group(), m.lastgroup
        if kind == "latin":
            if len(w) > 2:
                out.add(w)
        elif kind == "hangul":
            out |= {w[:2], w[:3]} if len(w) > 1 else set()
        elif kind == "kata":
            if len(w) > 1:
                out.add(w)
        else:
            out |= {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    return out


def _hash(x: str) -> int:
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _same() -> Column:
    return F.unhex(F.md5("text")).alias("same")


def _cut(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, same, seeds, sentences)``: each distinct text with its labels and its distinct sentences, their number
    and hashed phrases, under the least id of its documents; ``same`` tells texts apart."""
    sent = documents.sparkSession.sparkContext.broadcast(plain_table(documents.sparkSession))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        known: dict[str, list[int]] = {}  # sentences come again and again
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.slice(start, 500)
                sizes, numbers, lengths, held = [0], [], [0], []
                for text in part.column("text").to_pylist():
                    own: dict[str, int] = {}
                    for s in sentences(text, sent.value) if text else []:
                        k = _DIGITS.sub("0", s.strip())
                        own[k] = own.get(k, 0) + 1
                    for k, n in own.items():
                        if (found := known.get(k)) is None:
                            found = known[k] = [h if (h := hashes.get(p)) is not None else hashes.setdefault(p, _hash(p)) for p in phrases(k)]
                        numbers.append(n)
                        held += found
                        lengths.append(len(held))
                    sizes.append(len(numbers))
                if len(hashes) > 200_000 or len(known) > 50_000:
                    hashes.clear()
                    known.clear()
                inner = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(held, pa.int64()))
                said = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), inner], ["n", "phrases"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), part.column("seeds"), said], names=["doc_id", "same", "seeds", "sentences"])

    # copies meet within each task before anything is shuffled; labels find their text by its hash
    whole = documents.where("doc_id is not null and text <> ''")
    texts = whole.groupBy(_same()).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    given = whole.select("doc_id", _same()).join(labels, "doc_id").groupBy("same").agg(F.array_sort(F.collect_set("subject_id")).alias("seeds"))
    both = texts.join(given, "same", "left").select("doc_id", "same", F.coalesce("seeds", F.array().cast("array<int>")).alias("seeds"), "text")
    return both.mapInArrow(step, "doc_id long, same binary, seeds array<int>, sentences array<struct<n:int,phrases:array<long>>>")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of cut texts: the text of each sentence, its number, and the sentence and hash of each phrase."""
    lists = b.column("sentences")
    at = lists.offsets.to_numpy()
    structs = lists.flatten()
    owner = np.repeat(np.arange(len(b)), np.diff(at))
    n, inner = structs.field("n").to_numpy(zero_copy_only=False), structs.field("phrases")
    sizes = np.diff(inner.offsets.to_numpy())
    return owner, n, np.repeat(np.arange(len(n)), sizes), inner.flatten().to_numpy(zero_copy_only=False)


def _telling(cut: DataFrame, areas: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets hold phrases that tell a subject (the labelled texts among those that hold them, two at least,
    mostly agree), and which hold phrases that may (those, and the ones that two texts hold but too few labelled ones to
    say). Counted over all texts, within each task before anything is shuffled."""
    index = {s: i for i, s in enumerate(areas)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(areas) + 2, BUCKETS), np.int32)  # all, labelled, each subject
        for b in batches:
            owner, _, of, h = _flat(b)
            seen = np.unique(owner[of].astype(np.int64) * BUCKETS + (h & (BUCKETS - 1)))
            doc, bucket = seen // BUCKETS, seen % BUCKETS
            np.add.at(counts[0], bucket, 1)
            seeds = b.column("seeds").to_pylist()
            labelled = np.array([bool(x) for x in seeds], bool)
            np.add.at(counts[1], bucket[labelled[doc]], 1)
            for s, i in index.items():
                has = np.array([s in x for x in seeds], bool)
                np.add.at(counts[2 + i], bucket[has[doc]], 1)
        used = np.flatnonzero(counts[0])
        for i in range(0, len(used), 50_000):
            part = used[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array(c[part], pa.int64()) for c in counts]], names=["bucket", "n", "labelled", *[f"s{k}" for k in range(len(areas))]])

    names = [f"s{k}" for k in range(len(areas))]
    counted = cut.select("seeds", "sentences").mapInArrow(step, ", ".join(f"{c} long" for c in ["bucket", "n", "labelled", *names]))
    total = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["n", "labelled", *names]])
    lead = F.greatest(*names, F.lit(0)) if len(names) > 1 else F.col(names[0])
    kept = total.where("n > 1").withColumn("tells", (F.col("labelled") > 1) & ((lead + 0.5) / (F.col("labelled") + 1) > TELLING)).where("tells or labelled < 2").select("bucket", "tells").toPandas()
    tells, may = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool)  # at most BUCKETS numbers, whatever the corpus
    may[kept["bucket"].to_numpy(np.int64)] = True
    tells[kept["bucket"].to_numpy(np.int64)[kept["tells"].to_numpy(bool)]] = True
    return tells, may


def _described(cut: DataFrame, telling: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(doc_id, same, seeds, whole, sentences, phrases, core, mins)``: cut texts with the phrases of each sentence and of
    the text that may tell a subject, the number of all sentences, the phrases that do tell one (31 bits of their hashes,
    as they travel with every candidate link), and their minimum hashes."""
    sent = cut.sparkSession.sparkContext.broadcast(tuple(map(np.packbits, telling)))
    rng = np.random.default_rng(11)
    odd = [int(x) | 1 for x in rng.integers(1, 2**62, HASHES)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tells, may = (np.unpackbits(x).astype(bool) for x in sent.value)
        for b in batches:
            owner, n, of, h = _flat(b)
            whole = np.bincount(owner, n, len(b)).astype(np.int64)
            told = may[h & (BUCKETS - 1)]
            of, h = of[told], h[told]
            # sentences that are left, and their phrases
            left, start = np.unique(of, return_index=True)
            inner = pa.ListArray.from_arrays(pa.array(np.append(start, len(of)), pa.int32()), pa.array(h, pa.int64()))
            at = np.searchsorted(owner[left], np.arange(len(b) + 1))
            said = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(n[left], pa.int32()), inner], ["n", "phrases"]))
            # distinct phrases of each text
            doc = owner[of]
            order = np.lexsort((h, doc))
            doc, own = doc[order], h[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
            doc, own = doc[first], own[first]
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(b) + 1)), pa.int32()), pa.array(own, pa.int64()))
            sure = tells[own & (BUCKETS - 1)]
            doc, own = doc[sure], own[sure]
            ends = np.searchsorted(doc, np.arange(len(b) + 1))
            core = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((own & (2**31 - 1)).astype(np.int32), pa.int32()))
            some = np.flatnonzero(np.diff(ends))
            mins = np.zeros((len(some), HASHES), np.int64)
            for k, m in enumerate(odd):
                mixed = own.view(np.uint64) * np.uint64(m)
                mixed ^= mixed >> np.uint64(31)
                mins[:, k] = np.minimum.reduceat((mixed * np.uint64(m)) >> np.uint64(1), ends[some]).astype(np.int64) if len(some) else 0
            size = np.zeros(len(b) + 1, np.int64)
            size[some + 1] = HASHES
            least = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(mins.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), b.column("seeds"), pa.array(whole), said, held, core, least], names=["doc_id", "same", "seeds", "whole", "sentences", "phrases", "core", "mins"])

    kind = "doc_id long, same binary, seeds array<int>, whole long, sentences array<struct<n:int,phrases:array<long>>>, phrases array<long>, core array<int>, mins array<long>"
    return cut.mapInArrow(step, kind)


def graph(texts: DataFrame) -> DataFrame:
    """``(doc_id, seeds, core, mins)`` -> links ``(doc_id, centre, sim)``: candidates by minimum hashes, one centre a
    star, each verified by the exact Jaccard similarity of the two documents' phrases."""
    spot = texts.select("doc_id", (F.size("seeds") == 0).alias("bare"), F.posexplode("mins").alias("k", "m"))
    size = spot.groupBy("k", "m").agg(F.count("*").alias("n")).where("n > 1")
    stars = spot.join(size, ["k", "m"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "k"), F.ceil(F.col("n") / STAR))).drop("n")
    centre = stars.groupBy("k", "m", "part").agg(F.min(F.struct("bare", F.xxhash64("doc_id", "m").alias("h"), "doc_id")).alias("c")).select("k", "m", "part", F.col("c.doc_id").alias("centre"))
    near = stars.join(centre, ["k", "m", "part"]).where("doc_id <> centre").select("doc_id", "centre").distinct()
    own = texts.select("doc_id", F.col("core").alias("a"))
    other = texts.select(F.col("doc_id").alias("centre"), F.col("core").alias("b"))
    met = near.join(own, "doc_id").join(other, "centre").select("doc_id", "centre", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))
    sim = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return met.select("doc_id", "centre", sim.alias("sim")).where(F.col("sim") >= SIMILAR)


def spread_labels(links: DataFrame, seeds: DataFrame, areas: list[int]) -> tuple[DataFrame, DataFrame]:
    """Propagate ``seeds`` (doc_id, seeds) over ``links``: the subjects of each document ``(doc_id, about)`` once few
    change, and the trusted seeds ``(doc_id, seeds)`` that were clamped. In between a document has a weight for each
    subject, the mean of its neighbours'; a clamped one has 1 for each of its seeds."""
    spark = links.sparkSession
    # a link counts both ways; made by one pass over the links
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = stored(spark, links.select(F.explode(F.array(way("doc_id", "centre"), way("centre", "doc_id"))).alias("x"), "sim").select("x.*", "sim"), "links")
    subject = F.array(*[F.lit(x).cast("int") for x in areas])

    def ones(labels: DataFrame) -> DataFrame:
        return labels.select("doc_id", F.array(*[F.array_contains("seeds", x).cast("double") for x in areas]).alias("weights"))

    def voted(state: DataFrame) -> DataFrame:
        met = both.join(state.withColumnRenamed("doc_id", "src"), "src")
        sums = met.groupBy(F.col("dst").alias("doc_id")).agg(F.sum("sim").alias("all"), *[F.sum(F.col("sim") * F.col("weights")[i]).alias(f"s{i}") for i in range(len(areas))])
        return sums.select("doc_id", F.array(*[F.col(f"s{i}") / F.col("all") for i in range(len(areas))]).alias("weights"))

    def over(least: float, weights: str = "weights") -> Column:
        return F.filter(subject, lambda x, i: F.col(weights)[i] >= least)

    first = voted(ones(seeds))
    trusted = stored(spark, seeds.join(first, "doc_id").select("doc_id", F.array_intersect("seeds", over(BORNE)).alias("seeds")).where("size(seeds) > 0"), "trusted")
    state = ones(trusted).withColumn("own", F.col("weights"))  # what a clamped document keeps
    for _ in range(ROUNDS):
        new = voted(state.select("doc_id", "weights")).withColumnRenamed("weights", "new").join(state.withColumnRenamed("weights", "old"), "doc_id", "full")
        new = new.select("doc_id", F.coalesce("own", "new", "old").alias("weights"), "own", "old")
        state = stored(spark, new.withColumn("changed", F.col("old").isNull() | (over(HELD) != over(HELD, "old"))), "weights")
        changed, n = state.select(F.sum(F.col("changed").cast("int")), F.count("*")).head()
        state = state.select("doc_id", "weights", "own")
        if (changed or 0) <= CHANGED * n:
            break
    return state.select("doc_id", over(HELD).alias("about")).where("size(about) > 0"), trusted


def _phrase_counts(texts: DataFrame, about: DataFrame) -> DataFrame:
    """``(phrase, subject_id, c)``: documents that hold a phrase and are about a subject; subject -1 for all of them."""
    said = texts.select("doc_id", "phrases").join(about, "doc_id", "left")
    of = F.concat(F.array(F.lit(-1)), F.coalesce("about", F.array().cast("array<int>")))
    return said.select(of.alias("of"), F.explode("phrases").alias("phrase")).select("phrase", F.explode("of").alias("subject_id")).groupBy("phrase", "subject_id").agg(F.count("*").alias("c"))


def _links(counts: DataFrame, share: float = LINK_SHARE) -> DataFrame:
    """``(phrase, link)``: the subject that is ahead among a phrase's documents, with its strength; none where two are
    level."""
    # count and subject in one number, once with the subjects in reverse: level subjects give different ones
    rest = F.lit(2**31 - 1)
    top = F.when(F.col("subject_id") >= 0, F.shiftleft("c", 31))
    best = counts.groupBy("phrase").agg(
        F.max(top + F.col("subject_id")).alias("up"), F.max(top + rest - F.col("subject_id")).alias("down"), F.max(F.when(F.col("subject_id") < 0, F.col("c"))).alias("n")
    )
    best = best.select("phrase", "n", F.col("up").bitwiseAND(rest).alias("subject_id"), F.shiftright("up", 31).alias("c"), "down").where(F.col("subject_id") == rest - F.col("down").bitwiseAND(rest))
    strength = (F.col("c") + 0.5) / (F.col("n") + 2)
    # strength (in millionths) and subject in one number, so that the strongest is a plain maximum
    return best.where(strength >= share).select("phrase", (F.shiftleft((strength * 1_000_000).cast("long"), 31) + F.col("subject_id")).alias("link"))


def _shares(texts: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, subject_id, share)`` of the documents' sentences; a sentence takes the subject of its strongest link."""
    said = texts.select("doc_id", "whole", F.posexplode("sentences").alias("i", "x")).select("doc_id", "whole", "i", "x.n", F.explode("x.phrases").alias("phrase"))
    each = said.join(links, "phrase").groupBy("doc_id", "i").agg(F.max("link").alias("link"), F.max("n").alias("n"), F.max("whole").alias("whole"))
    subject = F.col("link").bitwiseAND(F.lit(2**31 - 1)).cast("int")
    return each.groupBy("doc_id", subject.alias("subject_id")).agg((F.sum("n") / F.max("whole")).alias("share"))


def propagate(documents: DataFrame, labels: DataFrame, areas: list[int]) -> DataFrame:
    """``(doc_id, subject_id, share, clamped)`` of every document and subject with any sentence of it or a trusted seed."""
    spark = documents.sparkSession
    given = labels.where("doc_id is not null and subject_id is not null").select("doc_id", F.col("subject_id").cast("int").alias("subject_id")).distinct()
    path = scratch(spark, "cut")
    _cut(documents, given).write.parquet(path)
    cut = spark.read.parquet(path)
    texts = stored(spark, _described(cut, _telling(cut, areas)), "described")
    remove(spark, path)
    seeds = texts.where("size(seeds) > 0").select("doc_id", "seeds")
    about, trusted = spread_labels(graph(texts), seeds, areas)
    for _ in range(COUNTS):
        found = stored(spark, _shares(texts, stored(spark, _links(_phrase_counts(texts, about)), "phrases")), "shares")
        about = found.where(F.col("share") >= SHARE).groupBy("doc_id").agg(F.collect_set("subject_id").alias("about"))
    # a trusted seed stays unless other subjects leave it less than a quarter of the sentences
    taken = found.groupBy("doc_id").agg(F.sum("share").alias("taken"))
    own = trusted.select("doc_id", F.explode("seeds").alias("subject_id")).join(found, ["doc_id", "subject_id"], "left").join(taken, "doc_id", "left")
    room = 1 - F.coalesce("taken", F.lit(0.0)) + F.coalesce("share", F.lit(0.0))
    clamped = own.where(room >= SHARE - 1e-9).select("doc_id", "subject_id", F.lit(True).alias("clamped"))
    every = found.join(clamped, ["doc_id", "subject_id"], "full").join(texts.select("doc_id", "same"), "doc_id")
    # every copy takes what was found for its text
    copies = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").alias("copy"), _same())
    return every.join(copies, "same").select(F.col("copy").alias("doc_id"), "subject_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("clamped", F.lit(False)).alias("clamped"))


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, subject_id)``: the subject areas of each document. ``areas`` is a table of a few subjects by contract."""
    known = sorted(r[0] for r in areas.where("subject_id is not null").select(F.col("subject_id").cast("int")).distinct().collect())
    if not known:
        return documents.select("doc_id", F.lit(None).cast("int").alias("subject_id")).limit(0)
    found = propagate(documents, labels.where(F.col("subject_id").isin(known)), known)
    return found.where((F.col("share") >= SHARE) | F.col("clamped")).select("doc_id", "subject_id").distinct()
