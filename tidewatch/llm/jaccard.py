"""N-gram Jaccard join: classes of documents that are linked by the Jaccard similarity of their word n-gram sets.

1. Each text becomes its set of distinct n-gram hashes (64 bits). Equal sets are one node; copies never meet again.
2. A count sketch of fixed size over all documents gives every n-gram a frequency class; n-grams are ordered by class,
   then hash, so rare ones come first everywhere. Two linked sets of size n and m share one of the first
   n - ceil(t n) + 1 n-grams of both: only these go into buckets. The sketch changes the work, never the result.
3. A bucket's smallest node is its pivot. All buckets of a pivot are one group of nodes. A large group is dealt into
   bounded chunks that each hold the pivot too. In a group only the n-grams that stand in some bucket travel at first:
   a trie join of these first parts in the global order, pruned by the lengths that remain, parts the group into the
   sets that may be linked. Only their texts are brought together, for a trie join of the whole sets in the same order
   from its frequent end. Where a large group has not become one class after that, its blocks of different classes and
   of like set sizes are joined pairwise in the same way. So every pair that shares a bucket has been ruled out,
   compared, or is already in one class.
4. Classes come from label propagation with pointer jumping over links to the smallest node of each local class.

Defined results: a null or blank text has no n-grams and is linked with nothing; a text of fewer than n words has one
n-gram, the whole sequence; rows with a null id get a null class and link nothing; repeated rows and ids are in one
class; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, map_pieces, materialise, text_bytes
from .trie import Union, join_group, link_group
from .words import NOT_SPACE, gram_hashes, join_texts, mix, word_hashes

WORDS = 4
NUMERATOR, DENOMINATOR = 85, 100
#: Counters of the frequency sketch, and how many travel in one row.
SKETCH = 1 << 20
SKETCH_ROW = 1 << 12
#: Marks of a first part: where in the order its parts end, for the bound on overlaps.
MARKS = 16
#: Parts that n-grams of first parts are dealt into at least, and how many of them a part should hold.
LEAST_PARTS = 256
PART_TOKENS = 1 << 20
#: Nodes and n-grams of one group that a task joins at a time.
GROUP_NODES = 96
GROUP_GRAMS = 400_000
PIECE_BYTES = 2 << 20
#: Ids that may be broadcast to pick texts out of the documents (16 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Parts that a node of very many copies is dealt into where the table of nodes is too large to broadcast.
SALTS = 16
#: Width of a band of set sizes, as a logarithm: a little over the ratio that linked sets may have.
BAND = math.log(DENOMINATOR / (NUMERATOR - 1))


def gram_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, edges = join_texts(texts)
    start, _, words = word_hashes(data, NOT_SPACE)
    cut = np.searchsorted(start, edges).tolist()
    grams = gram_hashes(words, WORDS)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        else:
            out.append(mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def spelled_grams(text: bytes) -> set:
    """The set of a text as words, without hashes; bytes are lower-cased in A-Z only, and split at the same white space."""
    w = text.lower().split()
    return {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else {tuple(w)} if w else set()


def node_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_classes(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """A frequency class, 0 to 127, for each slot of the sketch: all n-grams of all documents are counted."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE_BYTES):
                    size += len(texts[end])
                    end += 1
                for grams in gram_sets(texts[at:end]):
                    counts[(grams >> np.uint64(44)).astype(np.int64)] += 1  # sets: repeated slots are collisions and may count once
                at = end
        rows = counts.reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["part", "counts"])

    partial = in_small_batches(text_bytes(docs, id_col, text_col)).mapInArrow(run, "part long, counts binary")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROW, np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        step = np.minimum(127, 4 * np.log2(total + 1.0)).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "classes": pa.array([step.tobytes()], pa.binary())})

    classes = np.zeros((SKETCH // SKETCH_ROW, SKETCH_ROW), np.uint8)
    for r in partial.groupBy("part").applyInArrow(add, "part long, classes binary").collect():  # SKETCH bytes at most
        classes[r.part] = np.frombuffer(bytes(r.classes), np.uint8)
    return classes.ravel()


def ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """N-grams as numbers in the global order: the frequency class, then 55 bits of the hash."""
    return rank[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(55) | grams >> np.uint64(9)


def first_part(n: int) -> int:
    """How many n-grams the first part of a set of n has: n - ceil(t n) + 1."""
    return n + (-NUMERATOR * n // DENOMINATOR) + 1


def mark_places(length: int) -> np.ndarray:
    """Counts of n-grams, up to all, at which a first part of this length is marked."""
    return -(-np.arange(1, MARKS + 1) * length // MARKS)


def prepare(docs: DataFrame, classes, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, prefix, marks): set size, node, the rarest n-grams of every document, and evenly spaced ones of them."""

    def make():
        rank = classes.value

        def piece(batch):
            keys = batch.column(0)
            sizes, nodes, prefixes, marks = [], [], [], []
            for key, grams in zip(keys.to_pylist(), gram_sets([x or b"" for x in batch.column(1).to_pylist()]), strict=True):
                n = len(grams)
                sizes.append(n)
                nodes.append(node_id(grams) if n else None)
                if not n or key is None:
                    prefixes.append(None)
                    marks.append(None)
                    continue
                prefixes.append(np.sort(ordered(grams, rank))[: first_part(n)].view(np.int64))
                marks.append(prefixes[-1][mark_places(len(prefixes[-1])) - 1])
            return {id_col: keys, "n": sizes, "node": nodes, "prefix": prefixes, "marks": marks}

        return piece

    return map_pieces(text_bytes(docs, id_col, text_col), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n long, node long, prefix array<long>, marks array<long>", PIECE_BYTES)


def buckets_of(known: DataFrame) -> DataFrame:
    """(token, node, pivot) of the n-grams of first parts that several nodes have: pivot is the smallest of these nodes.

    N-grams are dealt by hash into parts of bounded size and meet once. The nodes of an Arrow batch send one row of arrays to
    a part, so that an n-gram and its node travel in 16 bytes, and nothing has to be joined back.
    """
    total = known.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(LEAST_PARTS, total // PART_TOKENS)

    def deal(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            tokens = prefix.flatten().to_numpy()
            nodes = np.repeat(batch.column("node").to_numpy(), prefix.value_lengths().to_numpy())
            part = (mix(tokens.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            used, counts = np.unique(part, return_counts=True)
            edges = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            columns = [pa.array(used), *(pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (tokens, nodes))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "tokens", "nodes"])

    def meet(table: pa.Table) -> pa.Table:
        tokens, nodes = (pc.list_flatten(table.column(c)).to_numpy() for c in ("tokens", "nodes"))
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        counts = np.diff(np.append(starts, len(tokens)))
        several = np.repeat(counts > 1, counts)
        pivots = np.repeat(nodes[starts], counts)
        return pa.table({"token": tokens[several], "node": nodes[several], "pivot": pivots[several]})

    dealt = in_small_batches(known.select("node", "prefix")).mapInArrow(deal, "part long, tokens array<long>, nodes array<long>")
    return dealt.groupBy("part").applyInArrow(meet, "token long, node long, pivot long")


def may_link(parts: list[list[int]], sizes: list[int], marks: list[list[int]]) -> Union:
    """Union of the sets that may be linked, by a trie join of their first parts, of which only bucketed n-grams travel.

    Up to the end of the first part that ends sooner, the overlap is the count in common; beyond, it is at most what is
    left of the shorter rest. Where the other set stands at that point is known to a step of its marks.
    """
    n = np.array(sizes)
    last = np.array([m[-1] for m in marks])
    reached = np.stack([np.append(0, mark_places(first_part(k)))[np.searchsorted(m, last, side="right")] for m, k in zip(marks, sizes, strict=True)])
    rest = n[:, None] - reached  # of i, beyond the end of j's first part
    beyond, furthest = np.minimum(rest, rest.T).tolist(), n.tolist()
    both = NUMERATOR + DENOMINATOR
    least_overlap = lambda i, size: -(-NUMERATOR * (sizes[i] + size) // both)
    most_beyond = rest.max(1).tolist()
    worth = lambda most, i, least: most + min(most_beyond[i], furthest[i]) >= least_overlap(i, least)
    met = lambda overlap, i, j: overlap + beyond[i][j] >= least_overlap(i, sizes[j])
    return join_group([np.sort(np.array(p, np.int64)) for p in parts], sizes, list(range(len(parts))), worth, met)


def runs(batches, keys: int):
    """(key, rows) of each run of equal first `keys` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def candidate_groups(members: DataFrame, grams: DataFrame) -> DataFrame:
    """(group, node, label): the sets of each group that may be linked, each connected part a group of its own.

    members has pivot, part, node and label; grams has node, n, its bucketed n-grams and its marks; parts with the same
    nodes come out as one group.
    """
    rows = members.join(grams, "node").select("pivot", "part", "node", "label", "n", "grams", "marks")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "node")

    def run(batches):
        for _, held in runs(batches, 2):
            held = [x for i, x in enumerate(held) if not i or x[0] != held[i - 1][0]]
            if len(held) < 2:
                continue
            nodes, labels, sizes, shared, marks = zip(*held, strict=True)
            union = may_link(shared, sizes, marks)
            parts: dict[int, list[int]] = {}
            for i in range(len(nodes)):
                parts.setdefault(union.root(i), []).append(i)
            good = [x for x in parts.values() if len({labels[i] for i in x}) > 1]
            if good:
                names = [node_id(np.array([nodes[i] for i in x], np.int64)) for x in good]
                flat = [(name, nodes[i], labels[i]) for name, x in zip(names, good, strict=True) for i in x]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["group", "node", "label"])

    return materialise(in_small_batches(rows).mapInArrow(run, "group long, node long, label long").distinct(), "candidates")


def trie_order(sets: list[np.ndarray], rank: np.ndarray) -> list[np.ndarray]:
    """Sets as ascending places in the global order from its frequent end: near copies share long runs there."""
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.lexsort((values, rank[(values >> np.uint64(44)).astype(np.int64)]))[::-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return [np.sort(x) for x in np.split(place[inverse], np.cumsum([len(x) for x in sets])[:-1])]


def join_groups(groups: DataFrame, texts: DataFrame, classes) -> DataFrame:
    """Links (node, root) inside every group: groups has group, node and label; texts has node and text.

    The trie works on hashes; two sets that it would link are compared as words once more.
    """
    rows = groups.join(texts, "node").select("group", "node", "label", "_bytes").repartition("group").sortWithinPartitions("group", "node")

    def run(batches):
        for _, held in runs(batches, 1):
            nodes, labels, data = zip(*held, strict=True)
            sets = gram_sets([x or b"" for x in data])
            good = [i for i, x in enumerate(sets) if node_id(x) == nodes[i]]  # an id may be used for other texts as well
            if len(good) < 2:
                continue
            spelled: dict[int, set] = {}

            def words(j: int, good=good, data=data, spelled=spelled) -> set:
                return spelled[j] if j in spelled else spelled.setdefault(j, spelled_grams(data[good[j]]))

            def certain(i: int, j: int, words=words) -> bool:
                a, b = words(i), words(j)
                return DENOMINATOR * (both := len(a & b)) >= NUMERATOR * (len(a) + len(b) - both)

            union = link_group(trie_order([sets[i] for i in good], classes.value), [labels[i] for i in good], NUMERATOR, DENOMINATOR, certain)
            least: dict[int, int] = {}
            for j, i in enumerate(good):
                r = union.root(j)
                least[r] = min(least.get(r, nodes[i]), nodes[i])
            pairs = {(nodes[i], least[union.root(j)]) for j, i in enumerate(good)}
            pairs = [(a, b) for a, b in pairs if a != b]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["node", "root"])

    return materialise(in_small_batches(rows).mapInArrow(run, "node long, root long"), "links")


def classes_of(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of a link."""
    edges = materialise(links.select("node", "root").unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root"))).distinct(), "links")
    labels = materialise(edges.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("root"), "label"), "root").select("node", "label")
        lower = heard.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        new = materialise(lower.join(jump, "label", "left").select("node", F.coalesce("_far", "label").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("_old"))
        if not new.join(old, "node").where("label <> _old").limit(1).count():
            return new
        labels = new


def pick_texts(docs: DataFrame, known: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of one document for each node; known has each node once with the smallest id of its documents."""
    ids = materialise(known.join(nodes, "node", "left_semi").select("node", id_col), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return text_bytes(docs, id_col, text_col).join(side, id_col).select("node", "_bytes")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): set size and the smallest id reachable by links, for every row."""
    classes = docs.sparkSession.sparkContext.broadcast(sketch_classes(docs, id_col, text_col))
    prepared = materialise(prepare(docs, classes, id_col, text_col), "prepared")
    # Copies are folded before anything is made of their n-grams; most of them already where they are read.
    folded = prepared.where(F.col("prefix").isNotNull()).groupBy("node").agg(F.min(id_col).alias(id_col), F.count("*").alias("_copies"), F.min(F.struct("n", "prefix", "marks")).alias("_first"))
    known = materialise(folded.select("node", id_col, "_copies", "_first.*"), "nodes")
    bucketed = materialise(buckets_of(known), "buckets")
    sizes_of = known.select("node", "n", "marks")
    grams = bucketed.groupBy("node").agg(F.collect_list("token").alias("grams")).join(sizes_of, "node")  # a first part at most
    grams = materialise(grams, "grams")
    stars = bucketed.where("node <> pivot").select("pivot", "node").distinct()
    stars = materialise(stars.join(known.select("node", "n"), "node").select("pivot", "node", "n"), "stars")
    chunks = F.greatest(F.ceil(F.count("*") / GROUP_NODES), F.ceil(F.sum("n") / GROUP_GRAMS)).cast("int")
    sizes = stars.groupBy("pivot").agg(chunks.alias("_chunks"))
    dealt = stars.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("string").alias("part"), "node")
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1).cast("array<string>")).alias("part"), F.col("pivot").alias("node"))

    def links_of(members: DataFrame) -> DataFrame:
        groups = candidate_groups(members, grams)
        return join_groups(groups, pick_texts(docs, known, groups.select("node").distinct(), id_col, text_col), classes)

    links = links_of(dealt.unionByName(pivots).withColumn("label", F.col("node")))
    labels = classes_of(links)
    large = sizes.where("_chunks > 1").select("pivot")
    if large.limit(1).count():
        members = block_members(stars.join(large, "pivot", "left_semi"), known.select("node", F.col("n").alias("_pivot_n")), labels)
        if members is not None:
            labels = classes_of(links.unionByName(links_of(members)))

    # The smallest id of a class comes from its nodes; rows of a node that is alone in its class have it at hand.
    joined = labels.join(known.select("node", id_col), "node")
    smallest = joined.groupBy("label").agg(F.min(id_col).alias("_least"))
    linked = joined.join(smallest, "label").select("node", "_least")
    copied = known.where("_copies > 1").join(labels, "node", "left_anti").select("node", F.col(id_col).alias("_least"))
    least = materialise(linked.unionByName(copied), "least")
    rows = prepared.select(id_col, "n", "node")
    if least.count() <= BROADCAST_IDS:
        found = rows.join(F.broadcast(least), "node", "left")
    else:  # a node of very many copies is dealt over tasks
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
        found = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS))).join(least.withColumn("_salt", salts), ["node", "_salt"], "left")
    return found.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col(id_col).isNotNull(), F.coalesce("_least", id_col)).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the smallest id of their class; rows with a null id stay, of equal rows one stays.

    Rows travel as one struct, so columns may have any name and type; rows are equal if their JSON is.
    """
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"), F.struct("*").alias("_row"))
    found = materialise(link_documents(rows.select("_id", "_text"), "_id", "_text"), "classes")
    gone = found.where("_id <> component_id").select("_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = rows.select("_id", "_row").join(F.broadcast(gone) if few else gone, "_id", "left_anti")
    repeated = materialise(found.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeated")
    if repeated.limit(1).count():  # unusual: else ids are unique, and no text needs to be shuffled
        same = kept["_id"].eqNullSafe(repeated["_id"])
        several = kept.join(repeated, same, "left_semi").groupBy("_id", F.sha2(F.to_json("_row"), 256).alias("_hash")).agg(F.any_value("_row").alias("_row"))
        kept = kept.join(repeated, same, "left_anti").select("_row").unionByName(several.select("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def block_members(stars: DataFrame, pivot_sizes: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Members (pivot, part, node, label) that bring different classes of large groups together; None if each is one class.

    Sets go into bands by size: linked ones are in one band or in neighbours. The part of a class in a band is dealt into
    blocks of bounded size, small ones of a group and band share blocks; pairs of blocks of one or neighbouring bands are
    joined except where both are of one class.
    """
    own = stars.select(F.col("pivot").alias("node")).distinct().join(pivot_sizes, "node").select(F.col("node").alias("pivot"), "node", F.col("_pivot_n").alias("n"))
    every = stars.select("pivot", "node", "n").unionByName(own)
    marked = every.join(labels, "node", "left").select("pivot", "node", F.floor(F.log(F.col("n").cast("double")) / BAND).alias("band"), "n", F.coalesce("label", "node").alias("label"))
    several = marked.groupBy("pivot").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("pivot")
    open_to = materialise(marked.join(several, "pivot", "left_semi"), "open")
    if not open_to.limit(1).count():
        return None
    fits = F.greatest(F.ceil(F.count("*") / GROUP_NODES), F.ceil(F.sum("n") / GROUP_GRAMS))
    sizes = open_to.groupBy("pivot", "band", "label").agg(fits.alias("_blocks"), F.count("*").alias("_nodes"), F.sum("n").alias("_grams"))
    small = (F.col("_blocks") == 1) & (F.col("_nodes") * 2 <= GROUP_NODES) & (F.col("_grams") * 2 <= GROUP_GRAMS)
    pools = sizes.where(small).groupBy("pivot", "band").agg(F.greatest(F.ceil(2 * F.sum("_nodes") / GROUP_NODES), F.ceil(2 * F.sum("_grams") / GROUP_GRAMS), F.lit(1)).alias("_pools"))
    named = sizes.join(pools, ["pivot", "band"], "left").withColumn("_small", small)
    pool = F.concat(F.lit("p"), F.pmod(F.xxhash64("label"), F.col("_pools")).cast("string"))
    name = F.concat_ws("/", F.col("band").cast("string"), F.when(F.col("_small"), F.col("_pool")).otherwise(F.concat_ws(":", "label", F.pmod(F.xxhash64("node"), F.col("_blocks")))))
    dealt = open_to.join(named.select("pivot", "band", "label", "_blocks", "_small", pool.alias("_pool")), ["pivot", "band", "label"])
    blocks = materialise(dealt.select("pivot", "band", "node", "label", name.alias("block"), F.when(~F.col("_small"), F.col("label")).alias("_only")), "blocks")
    names = blocks.select("pivot", "band", "block", "_only").distinct()
    other = names.select("pivot", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("block").alias("_other"), F.col("_only").alias("_other_only"))
    pairs = names.join(other, ["pivot", "band"]).where((F.col("block") <= F.col("_other")) & ~F.coalesce(F.col("_only") == F.col("_other_only"), F.lit(False)))
    part = F.concat_ws("|", "block", "_other").alias("part")
    wanted = pairs.select("pivot", "block", part).unionByName(pairs.where("block <> _other").select("pivot", F.col("_other").alias("block"), part))
    return blocks.join(wanted, ["pivot", "block"]).select("pivot", "part", "node", "label")
