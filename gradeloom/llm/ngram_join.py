"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are the distinct five-word shingles of a text (its whole word sequence when it has fewer), as 64-bit hashes. Every global
order used here puts tokens that only one distinct text has first and the shared ones after them, by a hash that differs per
order (families: by how common they are, rare ones first, and then by a hash). Two sets of similarity t or more share, under *every*
order, one of their first n - ceil(t n) + 1 tokens; a token of one text cannot be that one. So a text whose shared tokens are fewer
than t n drops out at once, and the others are met through the shared tokens left in their prefixes. Steps:

1. texts with equal sets form one class (copies meet nowhere again);
2. sharedness: tokens travel in packed blobs, once per batch and not per row, to the task of their hash range, which answers
   each batch with the tokens that other classes have too, and with how common they are. A token of a third of all texts is one entry per batch;
3. families: classes that share prefix tokens, rare tokens first, are brought together through each token's hub, linear in the prefixes. A passage
   of very many texts stands last in the order, so it does not bring them together, and families stay about as large as groups of near copies;
4. in a family of several blocks, every class is verified against the hub it shares most prefix tokens with. These links join most near
   copies, one comparison each;
5. a family is compared in blocks of bounded size, as matrices: pairs that step 4 has not joined must share a prefix token under every order
   (the filters are intersected one after the other), and what is left is verified on whole sets. Two blocks of classes that are joined already
   never meet. Of a block's links only a spanning set leaves the task;
6. these links are folded to components.

No pair of a group becomes a row, and no link between components is lost.

Null texts, texts without words: empty set, n_shingles 0, linked with nothing, component_id their own doc_id. Null doc_id: the row
stays, and takes its group's smallest doc_id (null if the group has none). Repeated rows: one class. Empty table: empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Memo, batches_of, clean_columns, documents, keeps, lean, lean_group, splitmix, stage, table
from gradeloom.llm.components import components

SIZE, NUMERATOR, DENOMINATOR = 5, 80, 100
ORDERS = 2
#: Tokens of one batch (map side) and of one hash range (reduce side): bounds of a task's memory.
BATCH_TOKENS, RANGE_TOKENS = 1 << 20, 1 << 21
#: Parts that a hash range is sorted in, one after the other; sets on a token from which on it counts as common.
SLICES, COMMON = 8, 8
#: Sets and tokens of a block whose pairs one task compares; rows and columns of its matrices at a time; from how many sets on a token
#: has a column.
BLOCK_SETS, BLOCK_TOKENS, ROWS, COLUMNS, OFTEN = 4096, 1 << 20, 512, 512, 24
#: Stands for "several classes of this batch"; a batch has fewer classes than this.
NOBODY = np.uint16(0xFFFF)

#: Kept small: every worker that has hashed words holds one until another operator's task.
_word_hash = Memo(xxhash.xxh64_intdigest, 1 << 17)
OWNER = "ngram_join"
keeps(OWNER, _word_hash.clear)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; A-Z lower-cased (bytes.lower touches ASCII only)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(words) - width + 1 + j]
    return np.unique(splitmix(rolled))


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def order_key(tokens: np.ndarray, order: int) -> np.ndarray:
    """Place of shared tokens in one of the global orders."""
    return splitmix(tokens + np.uint64((order + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def least_overlap(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Smallest intersection that a set of n needs with any partner."""
    return -(-num * n // den)


def prefix(shared: np.ndarray, n: int, order: int) -> np.ndarray:
    """Shared tokens among the first n - least + 1 tokens of the order (unshared ones stand first)."""
    keep = n - least_overlap(n) + 1 - (n - len(shared))
    return shared[np.argsort(order_key(shared, order), kind="stable")[:max(keep, 0)]]


def rarity(sets: np.ndarray) -> np.ndarray:
    """One byte that grows with the number of sets that have a token; 0 for all tokens that are not common."""
    return np.where(sets < COMMON, 0, np.minimum(8 * np.log2(np.maximum(sets, 1)), 255)).astype(np.uint8)


def rare_prefix(shared: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Shared tokens among the first n - least + 1 tokens, rare ones first (``common``: ``rarity`` of each)."""
    keep = len(shared) - least_overlap(n) + 1
    return shared[np.lexsort((order_key(shared, 0), common))[:max(keep, 0)]]


# ---- membership and sharedness ------------------------------------------------------------------------------------------------

MEMBER = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary())])
PACKED = pa.schema([("home", pa.int64()), ("batch", pa.binary()), ("tokens", pa.binary()), ("owner", pa.binary()), ("classes", pa.binary()),
                    ("sizes", pa.binary()), ("held", pa.binary())])
ANSWER = pa.schema([("batch", pa.binary()), ("tokens", pa.binary()), ("owner", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()),
                    ("common", pa.binary())])
SURVIVOR = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("shared", pa.binary()), ("first", pa.binary())])


def _members(carried: bool):
    shape = MEMBER.append(pa.field("row_key", pa.binary())) if carried else MEMBER

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                n.append(len(tokens))
                keys.append(set_key(tokens) if len(tokens) else None)
            more = {"row_key": batch.column("row_key")} if carried else {}
            yield table(shape, doc_id=batch.column("doc_id"), n_shingles=n, cls=keys, **more)

    return members


def _pack(ranges: int):
    """Batches of distinct classes: each distinct token once, to the task of its hash range; tokens that two classes of the
    batch have are known to be shared and stay with the batch."""
    width = range_width(ranges)

    def flush(sets: dict[bytes, np.ndarray], place: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        keys, arrays = list(sets), list(sets.values())
        sizes = np.array([len(a) for a in arrays], np.uint32)
        tokens, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays), dtype=np.uint32), sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[first, len(tokens)])
        many = np.repeat(count > 1, count)
        joined = b"".join(keys)
        # tasks that hold the same classes are different batches; a task run again gives the same names
        name = xxhash.xxh3_128_digest(np.array(place, np.int64).tobytes() + joined)
        rows = [(int.from_bytes(name[:4], "little") % ranges, tokens[many].tobytes(), owner[many].astype(np.uint16).tobytes(), joined, sizes.tobytes(), None)]
        once, whose = tokens[first], np.where(count > 1, NOBODY, owner[first].astype(np.uint16))
        home = (once // np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else []
        for a, b in zip(cuts, [*cuts[1:], len(home)], strict=True):
            held = np.minimum(count[a:b][whose[a:b] == NOBODY], 0xFFFF).astype(np.uint16)
            rows.append((int(home[a]), squeeze(once[a:b] - np.uint64(int(home[a]) * width)), whose[a:b].tobytes(), joined, None, held.tobytes()))
        cols = list(zip(*rows, strict=True))
        yield table(PACKED, home=cols[0], batch=[name] * len(rows), tokens=cols[1], owner=cols[2],
                    classes=[c if s is not None else _owners(c, o) for c, o, s in zip(cols[3], cols[2], cols[4], strict=True)], sizes=cols[4],
                    held=cols[5])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        task = TaskContext.get()
        total, part, flushes = 0, task.partitionId() if task else 0, 0
        for batch in batches:
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                if len(tokens) and (key := set_key(tokens)) not in held:
                    held[key] = tokens
                    total += len(tokens)
                    if total >= BATCH_TOKENS or len(held) == NOBODY:
                        yield from flush(held, (part, flushes))
                        held, total, flushes = {}, 0, flushes + 1
        if held:
            yield from flush(held, (part, flushes))

    return pack


def range_width(ranges: int) -> int:
    """Tokens per hash range."""
    return min(-(-(1 << 64) // ranges), (1 << 64) - 1)


def squeeze(values: np.ndarray) -> bytes:
    """Ascending values as differences of as many bytes as the largest one needs; that number stands first."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unsqueeze(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    steps = raw[1:].reshape(-1, raw[0])
    out = np.zeros((len(steps), 8), np.uint8)
    out[:, :raw[0]] = steps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _owners(classes: bytes, owner: bytes) -> bytes:
    """Short names (8 bytes) of the classes that own a range's tokens, after their numbers in the batch."""
    used = np.unique(np.frombuffer(owner, np.uint16))
    used = used[used != NOBODY]
    return used.tobytes() + np.frombuffer(classes, np.uint64).reshape(-1, 2)[used, 0].tobytes()


def _answer(ranges: int):
    width = range_width(ranges)

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        """For one hash range: the tokens of each batch that some other class has too. Of those that the batch knows to be shared, the common ones."""
        asked = group.filter(group.column("sizes").is_null())
        heads = group.filter(group.column("sizes").is_valid()).select(ANSWER.names[:-1])
        heads = heads.append_column("common", pa.nulls(len(heads), pa.binary())).cast(ANSWER)
        low = key[0].as_py() * width
        tokens = [unsqueeze(b.as_buffer()) + np.uint64(low) for b in asked.column("tokens")]
        if not tokens:
            return heads
        owners = [np.frombuffer(b.as_buffer(), np.uint16) for b in asked.column("owner")]
        named, held = [], []
        for blob, owner, counts in zip(asked.column("classes"), owners, asked.column("held"), strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            half = len(raw) // 10
            named.append((raw[:2 * half].view(np.uint16), raw[2 * half:].copy().view(np.uint64)))
            held.append(np.ones(len(owner), np.uint16))
            held[-1][owner == NOBODY] = np.frombuffer(counts.as_buffer(), np.uint16)
        # a batch's tokens ascend, so a slice of the range is a slice of every batch
        inner = np.array([min(low + width * k // SLICES, (1 << 64) - 1) for k in range(1, SLICES)], np.uint64)
        cuts = [[0, *np.searchsorted(t, inner).tolist(), len(t)] for t in tokens]
        out = [([], []) for _ in tokens]
        for k in range(SLICES):
            parts = [slice(c[k], c[k + 1]) for c in cuts]
            told = _told([t[p] for t, p in zip(tokens, parts, strict=True)], [o[p] for o, p in zip(owners, parts, strict=True)], named,
                         [h[p] for h, p in zip(held, parts, strict=True)])
            for (chosen, common), (x, y) in zip(out, told, strict=True):
                chosen.append(x)
                common.append(y)
        rows = []
        for batch, mine, owner, (chosen, common) in zip(asked.column("batch"), tokens, owners, out, strict=True):
            chosen = np.concatenate(chosen)
            if chosen.any():
                rows.append((batch.as_py(), mine[chosen].tobytes(), owner[chosen].tobytes(), np.concatenate(common)[chosen].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        empty = [None] * len(rows)
        found = table(ANSWER, batch=cols[0], tokens=cols[1], owner=cols[2], classes=empty, sizes=empty, common=cols[3])
        return pa.concat_tables([heads, pa.Table.from_batches([found])])

    return answer


def _told(tokens: list[np.ndarray], owners: list[np.ndarray], named: list[tuple[np.ndarray, np.ndarray]],
          held: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each batch's tokens in one slice of a range: which of them it is told of, and their ``rarity``."""
    every, many = np.concatenate(tokens), np.concatenate(owners) == NOBODY
    if not len(every):
        return [(np.zeros(0, bool), np.zeros(0, np.uint8))] * len(tokens)
    names = np.zeros(len(every), np.uint64)
    names[~many] = np.concatenate([short[np.searchsorted(used, o[o != NOBODY])] for o, (used, short) in zip(owners, named, strict=True)])
    by = np.argsort(every, kind="stable")
    t = every[by]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    run = np.diff(np.r_[start, len(t)])
    # one class in several batches is still one class; 0 marks a token that a batch knows to be shared
    least, most = np.minimum.reduceat(names[by], start), np.maximum.reduceat(names[by], start)
    chosen, common = np.zeros(len(t), bool), np.zeros(len(t), np.uint8)
    chosen[by] = np.repeat((least != most) | (least == 0), run)
    common[by] = np.repeat(rarity(np.add.reduceat(np.concatenate(held)[by], start, dtype=np.int64)), run)
    chosen &= ~many | (common > 0)  # those stay with their batch, which takes them for rare
    ends = np.cumsum([len(x) for x in tokens])[:-1]
    return list(zip(np.split(chosen, ends), np.split(common, ends), strict=True))


def _survivors(group: pa.Table) -> pa.Table:
    """The classes of a batch that have enough shared tokens to reach the threshold with anyone."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["sizes"] is not None)
    sizes = np.frombuffer(head["sizes"], np.uint32)
    told = [r for r in rows if r["sizes"] is None]
    tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in [*told, head]])
    owner = np.concatenate([np.frombuffer(r["owner"], np.uint16) for r in [*told, head]])
    common = np.zeros(len(tokens), np.uint8)
    at = len(tokens) - len(head["tokens"]) // 8
    common[:at] = np.concatenate([np.frombuffer(r["common"], np.uint8) for r in told] + [np.zeros(0, np.uint8)])
    several = np.flatnonzero(owner[:at] == NOBODY)  # tokens of several classes of this batch that are common
    if len(several):
        several = several[np.argsort(tokens[several])]
        place = np.minimum(np.searchsorted(tokens[several], tokens[at:]), len(several) - 1)
        common[at:] = np.where(tokens[several][place] == tokens[at:], common[several][place], 0)
    by = np.lexsort((tokens, owner))
    tokens, owner, common = tokens[by], owner[by], common[by]
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out = []
    for i in np.flatnonzero(np.diff(ends) > 0):
        n, shared = int(sizes[i]), tokens[ends[i]:ends[i + 1]]
        if len(shared) >= least_overlap(n):
            first = rare_prefix(shared, common[ends[i]:ends[i + 1]], n)
            out.append({"cls": head["classes"][16 * i:16 * i + 16], "n": n, "shared": shared.tobytes(), "first": first.tobytes()})
    return pa.Table.from_pylist(out, schema=SURVIVOR)


def memberships(docs: DataFrame, row_key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, cls (null for an empty set) and the ``row_key`` asked for, one row per row of ``docs``."""
    ddl = "doc_id long, n_shingles long, cls binary"
    if row_key is None:
        return clean_columns(docs, "doc_id", "text").mapInArrow(lean(_members(False), OWNER), ddl)
    return docs.select("doc_id", "text", row_key.alias("row_key")).mapInArrow(lean(_members(True), OWNER), f"{ddl}, row_key binary")


def survivors(docs: DataFrame, total_tokens: int) -> DataFrame:
    """Classes that can reach the threshold with another: cls, n, shared (their shared tokens, sorted), first (those of their prefix, rare first)."""
    ranges = max(1, math.ceil(total_tokens / RANGE_TOKENS))
    packed = clean_columns(docs, "text").mapInArrow(
        lean(_pack(ranges), OWNER), "home long, batch binary, tokens binary, owner binary, classes binary, sizes binary, held binary")
    answers = packed.groupBy("home").applyInArrow(lean_group(_answer(ranges)), "batch binary, tokens binary, owner binary, classes binary, sizes binary, common binary")
    found = answers.groupBy("batch").applyInArrow(lean_group(lambda key, group: _survivors(group)), "cls binary, n long, shared binary, first binary")
    return found.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "shared", "first")))


# ---- candidates and links -----------------------------------------------------------------------------------------------------

TOKEN = pa.schema([("cls", pa.binary()), ("token", pa.int64())])
LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches):
        firsts = [np.frombuffer(blob, np.int64) for blob in batch.column("first").to_pylist()]
        cls = batch.column("cls").take(pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])))
        yield pa.RecordBatch.from_arrays([cls, pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)]))], schema=TOKEN)


def families(alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, label: classes that prefixes, rare tokens first, bring together, directly or through others; and hub, cls, n: how many of its
    prefix tokens a class has at each hub, a token's smallest class. Linear in the prefixes."""
    tokens = stage(alive.select("cls", "first").mapInArrow(lean(_prefixes, OWNER), "cls binary, token long"))
    hubs = tokens.groupBy("token").agg(F.min("cls").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members")
    met = stage(tokens.join(hubs, "token").where("hub <> cls").groupBy("hub", "cls").agg(F.count("*").alias("n")))
    return components(met.select(F.col("hub").alias("a"), F.col("cls").alias("b"))), met


def _meetings(token: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each ``left`` set has in common with each ``right`` set: frequent tokens by matrix products, rare ones pair by pair."""
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    count = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]) if len(token) else np.zeros(0, np.int64)
    often = np.repeat(count >= OFTEN, count)
    column = np.repeat(np.cumsum(count >= OFTEN) - 1, count)
    total = np.zeros((len(left), len(right)), np.float32)
    columns = int((count >= OFTEN).sum())
    for low in range(0, columns, COLUMNS):
        part = often & (column >= low) & (column < low + COLUMNS)
        has = np.zeros((n, min(COLUMNS, columns - low)), np.float32)
        has[owner[part], column[part] - low] = 1
        total += has[left] @ has[right].T
    token, owner = token[~often], owner[~often]
    row, col = np.full(n, -1), np.full(n, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    places = [np.zeros(0, np.int64)]
    for apart in range(1, OFTEN):
        same = token[apart:] == token[:-apart]
        if not same.any():
            break
        x, y = owner[:-apart][same], owner[apart:][same]
        for p, q in ((x, y), (y, x)):
            places.append((row[p] * len(right) + col[q])[(row[p] >= 0) & (col[q] >= 0)])
    return total + np.bincount(np.concatenate(places), minlength=total.size).reshape(total.shape)


def alike_enough(both, a, b):
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def linked(sizes: np.ndarray, shared: list[np.ndarray], left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Matrix of links between the ``left`` and the ``right`` sets that are not joined yet: sizes in reach, prefixes that meet under every order,
    one order after the other on what the last one left, and then whole sets that are alike enough."""
    owner = np.repeat(np.arange(len(shared), dtype=np.int32), [len(x) for x in shared])
    _, token, df = np.unique(np.concatenate(shared), return_inverse=True, return_counts=True)
    token, start = token.astype(np.int32), np.cumsum([0, *map(len, shared)])
    meets = df[token] > 1  # tokens that meet nothing here are left out
    orders = []
    for k in range(ORDERS):
        first = np.zeros(len(token), bool)
        for i, x in enumerate(shared):
            first[start[i]:start[i + 1]] = np.isin(x, prefix(x, int(sizes[i]), k), assume_unique=True)
        orders.append((token[meets & first], owner[meets & first]))
    alike = np.zeros((len(left), len(right)), bool)
    for low in range(0, len(left), ROWS):
        rows = left[low:low + ROWS]
        may = joined[rows][:, None] != joined[right][None, :]
        small, great = np.minimum(sizes[rows][:, None], sizes[right][None, :]), np.maximum(sizes[rows][:, None], sizes[right][None, :])
        may &= DENOMINATOR * small >= NUMERATOR * great
        for t, o in orders:
            r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if len(r):
                may[np.ix_(r, c)] &= _meetings(t, o, len(shared), rows[r], right[c]) > 0
        r, c = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if len(r):
            both = _meetings(token[meets], owner[meets], len(shared), rows[r], right[c]).astype(np.int64)
            alike[np.ix_(low + r, c)] = may[np.ix_(r, c)] & alike_enough(both, sizes[rows[r]][:, None], sizes[right[c]][None, :])
    return alike


def spanning(alike: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest member that each member reaches through the links of one matrix and the groups it starts in (``label``: their smallest)."""
    n = len(label)
    while True:
        new = label.copy()
        for low in range(0, len(left), ROWS):
            part, rows = alike[low:low + ROWS], left[low:low + ROWS]
            np.minimum.at(new, rows, np.where(part, label[right][None, :], n).min(1, initial=n))
            np.minimum.at(new, right, np.where(part, label[rows][:, None], n).min(0, initial=n))
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(out: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], schema=LINK)


def _verify(group: pa.Table) -> pa.Table:
    """Links among the families of a group, or between two blocks of a large one; only a spanning set of them leaves the task."""
    out = []
    by: dict[bytes, list[int]] = {}
    for i, label in enumerate(group.column("label").to_pylist()):
        by.setdefault(label, []).append(i)
    cls, sizes, block = group.column("cls").to_pylist(), np.array(group.column("n").to_pylist(), np.int64), group.column("block").to_pylist()
    first_block, last_block = (np.array([b == x for b, x in zip(block, group.column(end).to_pylist(), strict=True)], bool) for end in ("low", "high"))
    near, blobs = group.column("near").to_pylist(), group.column("shared")
    for members in by.values():
        at = np.array(members)
        first: dict[bytes, int] = {}
        joined = np.array([first.setdefault(near[i], k) for k, i in enumerate(members)])
        shared = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in members]
        left, right = np.flatnonzero(first_block[at]), np.flatnonzero(last_block[at])
        root = spanning(linked(sizes[at], shared, left, right, joined), left, right, joined)
        # a group that was joined before is told of by its first member only
        out += [(cls[members[root[k]]], cls[members[k]]) for k in np.flatnonzero((root != joined) & (joined == np.arange(len(members))))]
    return _links(out)


def _star(group: pa.Table) -> pa.Table:
    """Links of classes to their hub; the hubs' own sets are rows of the group, with ``cls`` = ``hub``."""
    hubs, cls, n, blobs = (group.column(c).to_pylist() for c in ("hub", "cls", "n", "shared"))
    centre = {h: i for i, (h, c) in enumerate(zip(hubs, cls, strict=True)) if h == c}
    sets, out, last = {}, [], None
    for i in sorted(range(len(cls)), key=lambda i: hubs[i]):
        if cls[i] == hubs[i]:
            continue
        j = centre[hubs[i]]
        if j != last:  # one hub's set and prefixes at a time
            last, x = j, np.frombuffer(blobs[j], np.uint64)
            sets = [prefix(x, n[j], k) for k in range(ORDERS)]
        y = np.frombuffer(blobs[i], np.uint64)
        if all(np.isin(prefix(y, n[i], k), sets[k]).any() for k in range(ORDERS)):
            if alike_enough(len(np.intersect1d(x, y, assume_unique=True)), n[i], n[j]):
                out.append((cls[j], cls[i]))
    return _links(out)


def star_links(large: DataFrame, met: DataFrame, alive: DataFrame) -> DataFrame:
    """a, b: verified links of the classes of ``large`` (cls, tokens, blocks) to the hub that each shares most prefix tokens with.

    A hub's members are dealt over as many tasks as its family has blocks, and its set goes to each of them once.
    """
    best = met.join(large, "cls").groupBy("cls", "blocks").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    homes = max(1, math.ceil((large.agg(F.sum("tokens")).first()[0] or 0) / BLOCK_TOKENS))
    dealt = stage(best.select("hub", "cls", F.pmod(F.xxhash64("hub"), F.lit(homes)).alias("home"),
                              F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("part")))
    every = dealt.union(dealt.select("hub", F.col("hub").alias("cls"), "home", "part").distinct()).join(alive, "cls")
    return every.groupBy("home", "part").applyInArrow(lean_group(lambda key, group: _star(group)), "a binary, b binary")


def labels_of(alive: DataFrame) -> DataFrame:
    """node, label for the classes that have a link: the components of all links.

    A family is verified by blocks of about BLOCK_SETS sets and BLOCK_TOKENS tokens at most, whatever its size, each pair of blocks in a task of its
    own; small families share a task. In a large one, classes that their hubs join fill blocks of their own, which do not meet each
    other; the rest stands in common blocks.
    """
    length = (F.octet_length("shared") / 8).alias("tokens")
    family, met = families(alive)
    alive = alive.select("cls", "n", "shared")
    placed = stage(family.withColumnRenamed("node", "cls").join(alive.select("cls", length), "cls"))  # sets stay behind
    sums = (F.count("*").alias("sets"), F.sum("tokens").alias("tokens"))
    filled = F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)
    sizes = stage(placed.groupBy("label").agg(*sums).select("label", F.ceil(filled).cast("int").alias("blocks")))
    every = placed.agg(F.sum("tokens")).first()[0] or 0
    shelf = F.pmod(F.xxhash64("label"), F.lit(max(1, math.ceil(every / (BLOCK_TOKENS / 2)))))
    one = F.lit("")
    small = (placed.join(sizes.where("blocks = 1"), "label")
             .select("cls", "label", F.col("cls").alias("near"), one.alias("block"), F.concat(F.lit("s"), shelf.cast("string")).alias("home"),
                     one.alias("low"), one.alias("high")))
    large = stage(placed.join(sizes.where("blocks > 1"), "label"))
    stars = stage(star_links(large, met, alive))
    near = components(stars).select(F.col("node").alias("cls"), F.col("label").alias("near"))
    held = stage(large.join(near, "cls", "left").withColumn("near", F.coalesce("near", "cls")).select("cls", "label", "near", "tokens"))
    groups = held.groupBy("label", "near").agg(*sums).select("label", "near", filled.alias("filled"), (filled >= 0.5).alias("own"))
    common = groups.where("NOT own").groupBy("label").agg(F.ceil(F.sum("filled")).cast("int").alias("common"))
    blocks = groups.join(common, "label", "left").select("label", "near", "own", F.when(F.col("own"), F.ceil("filled")).otherwise(F.col("common")).alias("of"))
    mine = F.when(F.col("own"), F.hex("near")).otherwise("")
    dealt = stage(held.join(blocks, ["label", "near"])
                  .select("cls", "label", "near", mine.alias("mine"), F.concat_ws(":", mine, F.pmod(F.xxhash64("cls"), F.col("of")).cast("string")).alias("block")))
    others = dealt.select("label", "block", "mine").distinct().groupBy("label").agg(F.collect_list(F.struct("block", "mine")).alias("others"))
    meet = F.explode(F.filter("others", lambda o: (o["mine"] == "") | (o["mine"] != F.col("mine")))).alias("other")
    split = (dealt.join(others, "label").select("cls", "label", "near", "block", F.concat(F.lit("f"), F.hex("label")).alias("home"), meet)
             .select("cls", "label", "near", "block", "home", F.least("block", "other.block").alias("low"), F.greatest("block", "other.block").alias("high")))
    found = small.union(split).join(alive, "cls").groupBy("home", "low", "high").applyInArrow(lean_group(lambda key, group: _verify(group)), "a binary, b binary")
    return components(stage(found.union(stars)))


def near_duplicates(docs: DataFrame, row_key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, ``group_key`` (null for empty sets), and ``row_key`` if asked for, one row per row of ``docs``.

    ``row_key`` (binary) names the rows for a caller that wants their groups: doc_id does not, being null or repeated at times.
    """
    members = stage(memberships(docs, row_key))
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    alive = stage(survivors(docs, total))
    labels = stage(labels_of(alive))
    classes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    lookup = named.select("cls", "label").join(least, "label").select("cls", F.col("label").alias("group_key"), "component_id")
    return (members.join(lookup, "cls", "left")
            .select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    "group_key", *([] if row_key is None else ["row_key"])))


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws = [''] THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS t FROM w),
n AS (SELECT doc_id, len(t) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(t) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * m >= 80 * (na.n_shingles + nb.n_shingles - m)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN (
  WITH RECURSIVE r(node, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node)
  SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id
"""
