"""Jaccard self-join on word n-grams: rare-first prefix filtering, verified once per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.blocks import NULL_ID, Block, Blocks, flat, pack, pack_keys, split_sorted, unbundle, unpack, unpack_keys
from strata.llm.components import components
from strata.llm.stats import ids_of
from strata.llm.text import lower, mix, pair, ranges, slice_hashes, window_hashes, window_ok, word_spans

#: Postings of one key, or sets of one family, that meet in one place at most; more are cut into parts that meet pairwise.
PART = 1000
#: Keys of the sets that meet in one place for verification, about.
ELEMENTS = 1 << 20
_PARITY_WORDS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram keys in ascending order, and the texts' offsets into them.

    A text of fewer than n words, but one, has its whole sequence as one gram.
    """
    data = lower(data)
    starts, ends, words = word_spans(data, offsets)
    hashes = slice_hashes(data, starts, ends)
    at = np.flatnonzero(window_ok(words, n))
    grams, owner = window_hashes(hashes, n)[at], ids_of(words)[at]
    count = np.diff(words)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        whole = np.full(len(short), size, np.uint64)
        for k in range(size):
            whole = pair(whole, hashes[words[short] + k])
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort([grams, owner])
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[first], np.searchsorted(owner[first], np.arange(len(offsets)))


def parity(keys: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """For each set a bitmap with the parity of the number of its keys in each of 64 * words buckets.

    Two bitmaps differ in no more bits than the sets have keys that are not common.
    """
    n = len(offsets) - 1
    bucket = (mix(keys) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(ids_of(offsets) * (64 * words) + bucket, minlength=n * 64 * words).reshape(n, 64 * words) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")


class Links:
    """Labels of items that links have joined so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def of(self, items: np.ndarray) -> np.ndarray:
        while True:
            above = self.up[self.up[items]]
            if np.array_equal(above, self.up[items]):
                return above
            self.up[items] = above

    def join(self, a: np.ndarray, b: int) -> None:
        """Join all of a and b under their least item."""
        roots = np.unique(np.append(self.of(a), self.of(np.array([b]))))
        self.up[roots] = roots[0]


def _postings_families(payloads: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of all postings and, by candidates that pass all filters, each one's family: ids, blocks, rows, sizes, first id."""
    parts = [unpack(p) for p in payloads]
    key, cell, side, ids, rows, size, place, blocks = (np.concatenate([p[k] for p in parts]) for k in range(8))
    rest = np.concatenate([p[8].reshape(-1, _PARITY_WORDS) for p in parts])
    docs, first, who = np.unique(np.stack([ids, blocks, rows], axis=1), axis=0, return_index=True, return_inverse=True)
    who = who.ravel()
    links = Links(len(docs))
    order = np.lexsort([size, cell, key])
    key, cell = key[order], cell[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True]])) if len(order) else np.zeros(1, int)
    for a, b in zip(head[:-1], head[1:], strict=True):
        if b - a < 2:
            continue
        own = order[a:b]
        label = links.of(who[own])
        if (label == label[0]).all():
            continue
        n, p, s, bits, doc = size[own], place[own], side[own], rest[own], who[own]
        for i in range(1, b - a):
            lower_ = int(np.searchsorted(n[:i] * 100, percent * n[i]))  # length filter: sizes ascend
            j = np.arange(lower_, i)
            j = j[s[j] != s[i]] if cell[a] >= 0 else j
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            # Positional filter: at a pair's first common key, it and what follows must do.
            j = j[np.minimum(n[i] - p[i], n[j] - p[j]) >= need]
            if not len(j):
                continue
            j = j[links.of(doc[j]) != links.of(doc[i : i + 1])[0]]
            # Suffix filter: keys after this one that are on one side only, at least.
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
            after = (n[i] - p[i] - 1 + n[j] - p[j] - 1 - apart) // 2
            j = j[1 + after >= need]
            if len(j):
                links.join(doc[j], int(doc[i]))
    root = links.of(np.arange(len(docs)))
    return docs[:, 0], docs[:, 1], docs[:, 2], size[first], docs[root, 0]


def share(mine: np.ndarray, other: np.ndarray) -> int:
    """How many keys two sorted sets have in common."""
    if not len(mine) or not len(other):
        return 0
    at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
    return int((mine[at] == other).sum())


def similar(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    return (100 + percent) * share(mine, other) >= percent * (len(mine) + len(other))


def _rare_prefixes(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set the keys, rare first among these sets, that any link must touch: keys, sets (both by key, then set), and where each key's list begins."""
    size = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
    _, place, often = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort([every, often[place], owner])
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    first = order[rank < np.repeat(size - -(-percent * size // 100) + 1, size)]
    key, who = place[first], owner[first]
    by = np.lexsort([who, key])
    key, who = key[by], who[by]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, who, np.repeat(head, np.diff(np.append(head, len(key))))


def verify_links(sets: list[np.ndarray], sides: np.ndarray, across: bool, percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """Label of each sorted set, by links of Jaccard similarity of percent / 100 or more; if across, only between sides.

    ``labels``: those that earlier links have given. Only pairs that share a prefix key are
    candidates; one whose labels links have joined needs no verification, any other is
    verified once, after the length filter and a bound from parity bitmaps.
    """
    order = np.argsort(np.array([len(s) for s in sets], np.int64), kind="stable")
    ranked = [sets[i] for i in order.tolist()]
    n, side = np.array([len(s) for s in ranked], np.int64), sides[order]
    bits = parity(np.concatenate([*ranked, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(n)]), 8)
    label = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1].ravel()[order]
    _, who, begin = _rare_prefixes(ranked, percent)
    by = np.argsort(who, kind="stable")
    bounds = np.searchsorted(who[by], np.arange(len(sets) + 1))
    for i in range(1, len(sets)):
        entries = by[bounds[i] : bounds[i + 1]]
        # Sets ascend by size inside a key's list: those before i's entry are no larger.
        j = np.unique(who[ranges(begin[entries], entries - begin[entries])])
        j = j[(label[j] != label[i]) & (n[j] * 100 >= percent * n[i])]
        j = j[side[j] != side[i]] if across else j
        most = (n[i] + n[j] - np.bitwise_count(bits[j] ^ bits[i]).sum(1)) // 2
        fits = (100 + percent) * most >= percent * (n[i] + n[j])
        j, most = j[fits], most[fits]
        for k in j[np.argsort(-most, kind="stable")].tolist():
            if label[k] != label[i] and similar(ranked[i], ranked[k], percent):
                label[label == label[k]] = label[i]
    out = np.empty(len(sets), np.int64)
    out[order] = label
    return out


class _Sets:
    """The shingle sets of a block, and which rows stand for their class of equal sets."""

    def __init__(self, block: Block, n: int, counts: dict[str, int]):
        self.block, self.counts = block, counts
        self.keys, self.offsets = shingle_sets(block.data, block.offsets, n)
        self.size = np.diff(self.offsets)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set."""
        twice = []
        for seed in (1, 2):
            summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)), dtype=np.uint64)])
            twice.append(mix(summed[self.offsets[1:]] - summed[self.offsets[:-1]] + self.size.astype(np.uint64)))
        return twice[0], twice[1]

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the block's rows with a set: distinct signatures (two parts), least id, its row, and each row's place (-1 without a set)."""
        one, two = self.signatures()
        some = np.flatnonzero(self.size)
        order = some[np.lexsort([self.block.ids[some], two[some], one[some]])]
        head = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.zeros(0, bool)
        place = np.full(len(self.size), -1, np.int64)
        place[order] = np.cumsum(head) - 1
        first = order[head]
        return one[first], two[first], self.block.ids[first], first, place

    def leaders(self) -> tuple[np.ndarray, np.ndarray]:
        """The id that stands for each row's class, and the rows that stand for one."""
        one, _, ids, first, place = self.classes()
        best, here = ids.copy(), np.ones(len(ids), dtype=bool)
        for bucket, a, b in split_sorted(one, self.counts["classes"]):
            if bucket in self.block.answers.get("classes", {}):
                best[a:b], here[a:b] = unpack(self.block.answers["classes"][bucket])
        who = np.where(place >= 0, best[np.maximum(place, 0)] if len(best) else 0, self.block.ids)
        return who, np.sort(first[here])

    def chosen(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the sets of some rows, and their offsets."""
        at = ranges(self.offsets[rows], self.size[rows])
        return self.keys[at], np.concatenate([[0], np.cumsum(self.size[rows])])

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the leaders' sets, and how many of these sets hold them."""
        keys, _ = self.chosen(self.leaders()[1])
        ranked = np.sort(keys)
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
        return ranked[head], np.diff(np.append(head, len(ranked)))

    def postings(self, percent: int) -> tuple[np.ndarray, ...]:
        """Prefix keys of the leaders that may have a link, rare first: key, frequency, row, size, place, parity after it."""
        rows = self.leaders()[1]
        known, held = self.frequencies()
        total = held.astype(np.int64)
        for bucket, a, b in split_sorted(known, self.counts["frequency"]):
            if bucket in self.block.answers.get("frequency", {}):
                total[a:b] = unpack(self.block.answers["frequency"][bucket])[0]
        keys, offsets = self.chosen(rows)
        often = total[np.searchsorted(known, keys)]
        size = np.diff(offsets)
        shared = np.diff(np.concatenate([[0], np.cumsum(often > 1)])[offsets])
        # A link shares at least this much of the set, all of it with frequency 2 or more.
        least = -(-percent * size // 100)
        keep = np.flatnonzero(shared >= least)
        at = ranges(offsets[keep], size[keep])
        keys, often, owner = keys[at], often[at], np.repeat(np.arange(len(keep)), size[keep])
        order = np.lexsort([keys, often, owner])
        keys, often, owner = keys[order], often[order], owner[order]
        bounds = np.concatenate([[0], np.cumsum(size[keep])])
        place = np.arange(len(keys)) - bounds[owner]
        prefix = np.flatnonzero(place < (size - least + 1)[keep][owner])
        # Parity of what follows: of the whole set, less what stands up to here.
        whole = parity(keys, bounds, _PARITY_WORDS)
        bucket = mix(keys[prefix]) % np.uint64(64 * _PARITY_WORDS)
        single = np.zeros((len(prefix), _PARITY_WORDS), np.uint64)
        single[np.arange(len(prefix)), (bucket >> np.uint64(6)).astype(int)] = np.uint64(1) << (bucket & np.uint64(63))
        run = np.bitwise_xor.accumulate(single, axis=0) if len(prefix) else single
        head = np.searchsorted(owner[prefix], np.arange(len(keep)))
        before = np.zeros((len(keep), _PARITY_WORDS), np.uint64)
        inner = np.flatnonzero(head > 0)
        before[inner] = run[head[inner] - 1]
        after = whole[owner[prefix]] ^ run ^ before[owner[prefix]]
        used = often[prefix] > 1
        prefix = prefix[used]
        return keys[prefix], often[prefix], rows[keep][owner[prefix]], size[keep][owner[prefix]], place[prefix], after[used]


def _spread(often: np.ndarray, rows: np.ndarray, number: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, cell, side): where items of keys with long lists go. Cell -1: a short list's only place.

    A list of more than ``part`` is dealt to parts; each two of them, and each with itself, meet in a cell.
    """
    parts = -(-often // part)
    short = np.flatnonzero(parts < 2)
    items, cells, sides = [short], [np.full(len(short), -1)], [np.zeros(len(short), np.int64)]
    for item in np.flatnonzero(parts > 1).tolist():
        count = int(parts[item])
        own = int(mix(np.array([rows[item] * 2654435761 + number], np.int64).astype(np.uint64))[0] % np.uint64(count))
        other = np.arange(count)
        low, high = np.minimum(own, other), np.maximum(own, other)
        items.append(np.full(count, item))
        # Within its own part a row must meet all others: side is its number there.
        cells.append(np.where(own == other, -2 - own, low * count + high))
        sides.append(np.full(count, own))
    return np.concatenate(items), np.concatenate(cells).astype(np.int64), np.concatenate(sides).astype(np.int64)


def _link_documents(blocks: Blocks, n: int, percent: int) -> DataFrame:
    """id, n_shingles, component_id, block_id and row of every document."""
    counts = {"classes": blocks.ranges(1 << 30), "frequency": blocks.ranges(16 << 20), "postings": blocks.ranges(16 << 20)}
    part, elements = PART, ELEMENTS
    stage = blocks.stage

    def classes(block: Block) -> Iterator[tuple[int, bytes]]:
        one, two, ids, _, _ = _Sets(block, n, counts).classes()
        for bucket, a, b in split_sorted(one, counts["classes"]):
            yield bucket, flat(one[a:b], two[a:b], ids[a:b])

    def least(payloads: list[bytes]) -> list[bytes | None]:
        parts = [unpack(p) for p in payloads]
        one, two, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort([ids, two, one])
        head = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        best, here = np.empty(len(ids), np.int64), np.zeros(len(ids), dtype=bool)
        best[order] = ids[order[head]][np.cumsum(head) - 1]
        here[order[head]] = True
        edges = np.cumsum([0, *(len(p[0]) for p in parts)])
        return [pack(best[a:b], here[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def frequencies(block: Block) -> Iterator[tuple[int, bytes]]:
        keys, held = _Sets(block, n, counts).frequencies()
        for bucket, a, b in split_sorted(keys, counts["frequency"]):
            yield bucket, flat(held[a:b].astype(np.uint32), *pack_keys(keys[a:b]))

    def summed(payloads: list[bytes]) -> list[bytes | None]:
        parts = [unpack(p) for p in payloads]
        keys = [unpack_keys(p[1:]) for p in parts]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        total = np.add.reduceat(np.concatenate([p[0] for p in parts])[order].astype(np.int64), head)
        known = every[order[head]]
        return [pack(np.minimum(total[np.searchsorted(known, k)], 2**32 - 1).astype(np.uint32)) for k in keys]

    def postings(block: Block) -> Iterator[tuple[int, bytes]]:
        key, often, row, size, place, after = _Sets(block, n, counts).postings(percent)
        item, cell, side = _spread(often, row, block.number, part)
        # A cell of a long list is a place of its own.
        at = np.where(cell == -1, key[item], mix(key[item] + cell.astype(np.uint64)))
        order = np.argsort(at, kind="stable")
        item, cell, side, at = item[order], cell[order], side[order], at[order]
        for bucket, a, b in split_sorted(at, counts["postings"]):
            own = item[a:b]
            block_number = np.full(b - a, block.number)
            yield bucket, flat(key[own], cell[a:b], side[a:b], block.ids[row[own]], row[own], size[own], place[own], block_number, after[own])

    def families(group: pa.Table) -> pa.Table:
        ids, block, row, size, root = _postings_families(unbundle(group["payload"].to_pylist())[1], percent)
        return pa.table({"a": ids, "b": root, "block_id": block, "row": row, "size": size})

    blocks.ask("classes", classes, least)
    blocks.ask("frequency", frequencies, summed)
    # Every document of a posting, with the first id of its family there.
    near = stage.put(blocks.messages(postings).groupBy("bucket").applyInArrow(families, "a long, b long, block_id long, row long, size long"), "near")
    stage.drop("frequency")
    blocks.answers.pop("frequency")
    family = components(near, stage, "family")
    nodes = near.select(F.col("a").alias("id"), "block_id", "row", "size").distinct().join(family, "id")
    # The member of about the mean size stands for its family and is held against every other one, in their blocks.
    means = nodes.groupBy("component").agg(F.avg("size").alias("mean"))
    chosen = nodes.join(means, "component").groupBy("component").agg(F.min(F.struct(F.abs(F.col("size") - F.col("mean")), "id", "block_id", "row")).alias("rep"))
    nodes = stage.put(nodes.join(chosen, "component").select("component", "id", "block_id", "row", "size", F.col("rep.id").alias("rep"), F.col("rep.block_id").alias("rep_block"), F.col("rep.row").alias("rep_row")), "nodes")

    def told(*columns: str) -> Callable[[pa.Table], pa.Table]:
        def one(group: pa.Table) -> pa.Table:
            data = pack(*(group[c].to_numpy() for c in columns))
            return pa.table({"block_id": group["block_id"].slice(0, 1), "bucket": pa.array([0], pa.int32()), "payload": pa.array([data], pa.binary()), "totals": pa.array([None], pa.list_(pa.int64()))})

        return one

    def answer(name: str, rows: DataFrame, *columns: str) -> None:
        blocks.answers[name] = stage.put(rows.groupBy("block_id").applyInArrow(told(*columns), "block_id long, bucket int, payload binary, totals array<long>"), name)

    def forget(*names: str) -> None:
        for name in names:
            blocks.answers.pop(name)
        stage.drop(*names)

    def of_rows(name: str) -> Callable[[Block], Iterator[pa.RecordBatch]]:
        def given(block: Block) -> Iterator[pa.RecordBatch]:
            """family and the keys of the rows that the answer names."""
            if 0 in block.answers.get(name, {}):
                row, family_ = unpack(block.answers[name][0])
                sets = _Sets(block, n, counts)
                for at in range(0, len(row), 500):
                    keys = [sets.keys[sets.offsets[r] : sets.offsets[r + 1]].tobytes() for r in row[at : at + 500].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(family_[at : at + 500]), pa.array(keys, pa.binary())], names=["family", "keys"])

        return given

    answer("rep_rows", nodes.where("id = rep AND block_id = rep_block AND row = rep_row"), "row", "component")
    reps = stage.put(blocks.map(of_rows("rep_rows"), "family long, keys binary"), "reps")
    forget("rep_rows")
    others = nodes.where("NOT (id = rep AND block_id = rep_block AND row = rep_row)")
    answer("others", others, "row", "component", "rep")

    def rep_sets(group: pa.Table) -> pa.Table:
        sizes = np.array([len(k) // 8 for k in group["keys"].to_pylist()], np.int64)
        data = pack(group["family"].to_numpy(), sizes, np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64))
        return pa.table({"block_id": group["block_id"].slice(0, 1), "bucket": pa.array([0], pa.int32()), "payload": pa.array([data], pa.binary()), "totals": pa.array([None], pa.list_(pa.int64()))})

    sent = others.select(F.col("component").alias("family"), "block_id").distinct().join(reps, "family")
    blocks.answers["rep_sets"] = stage.put(sent.groupBy("block_id").applyInArrow(rep_sets, "block_id long, bucket int, payload binary, totals array<long>"), "rep_sets")

    def star(block: Block) -> Iterator[pa.RecordBatch]:
        if 0 not in block.answers.get("others", {}):
            return
        row, family_, rep = unpack(block.answers["others"][0])
        known, sizes, keys = unpack(block.answers["rep_sets"][0])
        ends = np.cumsum(sizes)
        of = {f: keys[b - s : b] for f, s, b in zip(known.tolist(), sizes.tolist(), ends.tolist(), strict=True)}
        sets = _Sets(block, n, counts)
        linked = [similar(of[f], sets.keys[sets.offsets[r] : sets.offsets[r + 1]], percent) for r, f in zip(row.tolist(), family_.tolist(), strict=True)]
        columns = [pa.array(block.ids[row]), pa.array(family_), pa.array(rep), pa.array(np.full(len(row), block.number)), pa.array(row), pa.array(sets.size[row]), pa.array(linked, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "family", "rep", "block_id", "row", "size", "linked"])

    tried = stage.put(blocks.map(star, "id long, family long, rep long, block_id long, row long, size long, linked boolean"), "star")
    forget("others", "rep_sets")
    # What isn't linked to its family's member meets all the rest of the family.
    count = lambda f: [F.count(F.when(f, 1)).alias("m"), F.coalesce(F.sum(F.when(f, F.col("size"))), F.lit(0)).alias("e")]
    sums = tried.groupBy("family").agg(*(c.alias(x) for c, x in zip([*count(~F.col("linked")), *count(F.col("linked"))], ("mu", "eu", "ml", "el"), strict=True))).where("mu > 0 AND mu + ml > 1")
    cut = lambda m, e: F.greatest(F.ceil(F.col(m) / part), F.ceil(F.col(e) / elements)).cast("long")
    left = tried.join(sums.select("family", cut("mu", "eu").alias("apart"), cut("ml", "el").alias("joined")), "family")
    answer("left", left.withColumn("linked", F.col("linked").cast("long")), "row", "family", "linked", "apart", "joined")

    def members(block: Block) -> Iterator[pa.RecordBatch]:
        if 0 not in block.answers.get("left", {}):
            return
        sets = _Sets(block, n, counts)
        out: list[dict[str, object]] = []
        for r, f, linked, apart, joined in zip(*(x.tolist() for x in unpack(block.answers["left"][0])), strict=True):
            own = int(mix(np.array([r * 2654435761 + block.number], np.int64).astype(np.uint64))[0] % np.uint64(joined if linked else apart))
            data = sets.keys[sets.offsets[r] : sets.offsets[r + 1]].tobytes()
            # Parts of the unlinked are numbered first, then those of the linked; a cell is a pair of parts.
            pairs = [(u, apart + own) for u in range(apart)] if linked else [(min(own, u), max(own, u)) for u in range(apart)] + [(own, apart + k) for k in range(joined)]
            side = apart + own if linked else own
            out += [{"family": f, "cell": a << 32 | b, "side": side, "id": int(block.ids[r]), "linked": bool(linked), "keys": data} for a, b in pairs]
            if len(out) > 500:
                yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)

    def verified(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("side", "ascending")])
        ids, sides, linked = group["id"].to_numpy(), group["side"].to_numpy(), group["linked"].to_numpy()
        before = np.where(linked, -1, np.arange(len(ids)))
        cell = group["cell"][0].as_py()
        label = verify_links([np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()], sides, cell >> 32 != cell & 0xFFFFFFFF, percent, before)
        order = np.lexsort([ids, label])
        head = np.concatenate([[True], label[order][1:] != label[order][:-1]])
        least_ = np.empty(len(ids), np.int64)
        least_[order] = ids[order[head]][np.cumsum(head) - 1]
        joined = least_ != ids
        return pa.table({"a": ids[joined], "b": least_[joined]})

    met = blocks.map(members, "family long, cell long, side long, id long, linked boolean, keys binary").groupBy("family", "cell").applyInArrow(verified, "a long, b long")
    links = stage.put(met.unionByName(tried.where("linked").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "links")
    forget("left")
    stage.drop("star", "reps", "nodes", "near")
    joined = components(links, stage, "linked").select(F.col("id").alias("leader"), "component")

    def rows(block: Block) -> Iterator[pa.RecordBatch]:
        sets = _Sets(block, n, counts)
        leader, _ = sets.leaders()
        columns = [block.ids, sets.size, leader, np.full(len(leader), block.number), np.arange(len(leader))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "n_shingles", "leader", "block_id", "row"])

    every = blocks.map(rows, "id long, n_shingles long, leader long, block_id long, row long")
    return every.join(joined, "leader", "left").select("id", "n_shingles", F.coalesce("component", "leader").alias("component_id"), "block_id", "row")


_MEMBER = pa.schema([("family", pa.int64()), ("cell", pa.int64()), ("side", pa.int64()), ("id", pa.int64()), ("linked", pa.bool_()), ("keys", pa.binary())])


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id it reaches by links).

    Two documents link when their sets of word n-grams (A-Z lower-cased) have a Jaccard
    similarity of ``percent`` / 100 or more. Equal sets are one class, of which the least
    id stands for all. Each set's grams are ordered rare first by their exact frequency among classes; only the prefix that any link must
    touch is sent, and only grams that another class has. Where prefix grams meet, candidates pass the
    length, positional and suffix filters (the last by parity bitmaps of what follows the gram) and form
    families. A family's member of about the mean size is sent to the blocks of the others and each is verified against it, so a large group of near copies
    costs one comparison a member. Sets not linked to it meet the rest of the family, where pairs that share a prefix gram
    and that no links have joined yet are verified once. Long posting lists and large families are cut into parts that meet pairwise, so no task holds an unbounded group.

    Ids are integers. A null or empty text has no set and is linked with nothing; one of fewer than n words has its whole sequence as one gram. A null
    id comes before all others. Rows with the same id are one document for links. An empty
    table gives no rows; other columns are ignored.
    """
    blocks = Blocks(docs, id_col, text_col, "ngram_join")
    out = _link_documents(blocks, n, percent).select("id", "n_shingles", "component_id")
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return blocks.finish(out.select(null("id"), "n_shingles", null("component_id")).withColumnRenamed("id", id_col), "links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the least of its component (see ``join_similar``).

    Rows without a set stay. Rows that share the least id all stay.
    """
    blocks = Blocks(docs, id_col, text_col, "ngram_join", carry=True)
    found = _link_documents(blocks, n, percent).where("id <> component_id")
    return blocks.without(found)
