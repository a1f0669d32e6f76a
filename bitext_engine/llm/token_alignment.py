"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, by lockstep merging.

A text is encoded by a byte-level BPE (A, a space before the text) and by a piece model (B, which adds that space itself).
Both never join what stands on both sides of a single space between visible characters, so a text is looked up by its words,
of which a worker encodes each once while it remembers it (two generations of bounded size, which changes no result).

The merge works on a slice of documents at once. Byte ends of all A tokens and of all B tokens are two long arrays; a state
vector holds an A pointer and a B pointer for every lane. Each step compares the two ends of all lanes, emits a
link and a cut where they are equal, and advances the pointer that is behind, or both; finished lanes are compacted away. A
lane is a document; a long one is several, cut at words, where tokens of both kinds end anyway.

How often an id pair is linked in the whole corpus is counted from one row a slice, joined back to slices (not to
documents) by the pair, and summed over each document's distinct pairs where slice and documents meet again.

Defined cases: texts that are null, empty, or whose joined tokens of A or B differ from space + text have no tokens and give
zeros and an empty groups string; null and repeated doc_ids are rows of their own; texts of any length are taken in pieces
of bounded size; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import partitions, saved, table
from bitext_engine.llm.tokens import Memo, tokenizer_path
from bitext_engine.llm.worker_memory import claim, releasing

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE = 4 << 20  # bytes of text merged at a time; a longer text is cut
LANE = 512  # A tokens of a lane, about
_aligners: dict[tuple[str, str], "Aligner"] = {}
ODD = np.uint32(0xFFFFFFFF)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves,
    the other bytes follow from U+0100 on in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _solid(c: str) -> bool:
    """Neither tokenizer takes c for white space."""
    return "!" <= c <= "~" or c.isalnum()


def lockstep(ends_a, ends_b, at_a, at_b, to_a):
    """(A tokens, B tokens) that end together, of all lanes, in order of A. Lane i holds the A tokens from at_a[i] up to
    to_a[i] and the B tokens from at_b[i] on; its last tokens end together."""
    found_a, found_b = [], []
    while len(at_a):
        x, y = ends_a[at_a], ends_b[at_b]
        same = x == y
        if same.any():
            found_a.append(at_a[same])
            found_b.append(at_b[same])
        at_a, at_b = at_a + (x <= y), at_b + (y <= x)
        live = at_a < to_a
        if not live.all():
            at_a, at_b, to_a = at_a[live], at_b[live], to_a[live]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


def _gather(store, starts, sizes):
    ends = np.cumsum(sizes)
    return store[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte, vocabulary = byte_of_char(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte.get(c, 0) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B goes on over a space: words cannot be looked up by themselves")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.n_digits = np.array([len(str(i)) for i in range(most)])
        self.digits = np.zeros((most, 6), np.uint8)
        for i in range(most):
            self.digits[i, : self.n_digits[i]] = list(str(i).encode())
        self.written = np.arange(6) < self.n_digits[:, None]
        self.written[:, 5] = True  # the mark behind it
        self.words = Memo()

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Number of A ids, A ids, B ids of each word with the space before it; ODD if its bytes come back otherwise."""
        found = self.words.lookup(words)
        new = [i for i, value in enumerate(found) if value is None]
        if new:
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + words[i] for i in new], add_special_tokens=False)]
            ids_b = self.b.encode([words[i] for i in new], num_threads=1)
            for i, a, b in zip(new, ids_a, ids_b, strict=True):
                text = (" " + words[i]).encode()
                well = b"".join([self.bytes_a[x] for x in a]) == text and b"".join([self.bytes_b[x] for x in b]) == text
                found[i] = np.array([len(a), *a, *b] if well else [ODD], "<u4").tobytes()
                self.words.learn(words[i], found[i])
        return found

    def _words(self, texts: pa.Array):
        """(numbers of distinct words in order, distinct words, words of each text)."""
        lists = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = pc.list_flatten(lists).dictionary_encode()
        which, names = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_pylist()
        starts_well = np.fromiter((bool(p) and _solid(p[0]) for p in names), bool, len(names))
        ends_well = np.fromiter((bool(p) and _solid(p[-1]) for p in names), bool, len(names))
        begins = np.ones(len(which), bool)
        begins[1:] = starts_well[which[1:]] & ends_well[which[:-1]]
        first_part = np.cumsum(per_text) - per_text
        begins[first_part] = True
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(which)))
        word = which[at]
        joined: dict[str, int] = {}
        for i in np.flatnonzero(size > 1).tolist():
            text = " ".join([names[p] for p in which[at[i] : at[i] + size[i]].tolist()])
            word[i] = joined.setdefault(text, len(joined)) + len(names)
        return word, names + list(joined), np.add.reduceat(begins, first_part).astype(np.int64)

    def align(self, texts: list[str]):
        """For each text (number of A tokens, B tokens, links, groups as bytes, codes of id pairs, their numbers), None where it
        has no tokens. The code of a pair is A id * 65536 + B id."""
        word, names, per_text = self._words(pa.array(texts, pa.large_string()))
        coded = self._look_up(names)
        store = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        start = np.cumsum(size) - size
        n_a = store[start].astype(np.int64)
        odd = n_a == ODD
        text_of = np.repeat(np.arange(len(texts)), per_text)
        well = np.ones(len(texts), bool)
        if odd.any():
            well[text_of[odd[word]]] = False
            word, text_of = word[well[text_of]], text_of[well[text_of]]
        out: list = [None] * len(texts)
        if not len(word):
            return out
        word_a, word_b = n_a[word], size[word] - 1 - n_a[word]
        a, b = _gather(store, start[word] + 1, word_a), _gather(store, start[word] + 1 + word_a, word_b)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at_a, at_b = np.cumsum(word_a) - word_a, np.cumsum(word_b) - word_b
        # lanes: a text, cut where its A tokens pass a multiple of LANE
        first = np.append(True, text_of[1:] != text_of[:-1])
        text_at = at_a[first][np.cumsum(first) - 1]
        turn = (at_a - text_at) // LANE
        lane = np.flatnonzero(first | np.append(True, turn[1:] != turn[:-1]))
        link_a, link_b = lockstep(ends_a, ends_b, at_a[lane], at_b[lane], np.append(at_a[lane][1:], len(a)))

        # groups as text: ids of A, a bar, ids of B, a semicolon
        sizes_a, sizes_b = np.diff(link_a, prepend=-1), np.diff(link_b, prepend=-1)
        group = np.arange(len(link_a))
        group_a, group_b = np.repeat(group, sizes_a), np.repeat(group, sizes_b)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.append(0, link_b[:-1] + 1)[group_a]] = a
        ids[np.arange(len(b)) + (link_a + 1)[group_b]] = b
        mark[link_a + np.append(0, link_b[:-1] + 1)] = ord("|")
        mark[link_b + link_a + 1] = ord(";")
        grid = self.digits[ids]
        grid[:, 5] = mark
        written = grid[self.written[ids]].tobytes()
        text_ends = np.cumsum(self.n_digits[ids] + 1)

        codes = a[link_a].astype(np.int64) << 16 | b[link_b]
        which = np.flatnonzero(first)
        texts_at = text_of[which]
        last_a = np.append(at_a[which][1:], len(a))
        last_b = np.append(at_b[which][1:], len(b))
        last_link = np.searchsorted(link_a, last_a)
        link_text = np.repeat(np.arange(len(which)), np.diff(last_link, prepend=0))
        order = np.argsort(link_text << 33 | codes, kind="stable")
        pair = (link_text << 33 | codes)[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts, pair = np.diff(np.append(new, len(pair))), pair[new]
        pair_at = np.searchsorted(pair, np.arange(len(which) + 1) << 33)
        from_a = from_b = from_text = from_link = 0
        for i, t in enumerate(texts_at.tolist()):
            to_a, to_b, to_link = int(last_a[i]), int(last_b[i]), int(last_link[i])
            to_text = int(text_ends[to_a + to_b - 1])
            p, q = pair_at[i], pair_at[i + 1]
            out[t] = (to_a - from_a, to_b - from_b, to_link - from_link, written[from_text : to_text - 1], pair[p:q] & ((1 << 33) - 1), counts[p:q])
            from_a, from_b, from_text, from_link = to_a, to_b, to_text, to_link
        return out

    def long(self, text: str):
        """The same of one text of any length, piece by piece; the groups as their hash."""
        n_a = n_b = n_links = at = 0
        digest, totals, first = hashlib.sha256(), {}, True
        while at < len(text):
            to = at + SLICE // 4
            while to < len(text):  # a space between visible characters
                to = text.find(" ", to)
                if to < 0 or to + 1 >= len(text):
                    to = len(text)
                elif _solid(text[to - 1]) and _solid(text[to + 1]):
                    break
                else:
                    to += 1
            (found,) = self.align([text[at:to]])
            if found is None:
                return None
            n_a, n_b, n_links = n_a + found[0], n_b + found[1], n_links + found[2]
            digest.update((b"" if first else b";") + found[3])
            for code, n in zip(found[4].tolist(), found[5].tolist(), strict=True):
                totals[code] = totals.get(code, 0) + n
            first, at = False, to + 1
        codes = np.array(sorted(totals), np.int64)
        return n_a, n_b, n_links, digest, codes, np.array([totals[c] for c in codes.tolist()], np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    claim("alignment", _aligners.clear)
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _sliced(texts: list[str | None]):
    """(first, last) of runs of rows of about SLICE characters."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE // 2:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


ALIGNED = "doc_id long, part long, n_a long, n_b long, n_links long, groups_sha256 string, codes array<long>, counts array<long>"


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row of ALIGNED for every document, and one with null n_a for every slice (part) with the pairs of its documents."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def work(batches):
        from pyspark import TaskContext

        align, part = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text").to_pylist()
            for a, b in _sliced(texts):
                short = [i for i in range(a, b) if texts[i] and len(texts[i]) < SLICE // 2]
                found = dict(zip(short, align.align([texts[i] for i in short]), strict=True)) if short else {}
                found |= {i: align.long(texts[i]) for i in range(a, b) if texts[i] and i not in found}
                rows = [found.get(i) or (0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in range(a, b)]
                hashes = ["" if r[3] is None else (hashlib.sha256(r[3]) if isinstance(r[3], bytes) else r[3]).hexdigest() for r in rows]
                codes, counts = (np.concatenate([r[k] for r in rows]) for k in (4, 5))
                all_codes, which = np.unique(codes, return_inverse=True)
                all_counts = np.bincount(which, counts, len(all_codes)).astype(np.int64)
                ends = np.cumsum([0, *(len(r[4]) for r in rows), len(all_codes)]).astype("i4")
                columns = [
                    pa.concat_arrays([doc_ids.slice(a, b - a), pa.nulls(1, pa.int64())]), pa.array(np.full(len(rows) + 1, part)),
                    *(pa.array([*(r[k] for r in rows), None], pa.int64()) for k in (0, 1, 2)), pa.array([*hashes, None], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.append(codes, all_codes))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.append(counts, all_counts))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "n_a", "n_b", "n_links", "groups_sha256", "codes", "counts"])
                part += 1

    return docs.select("doc_id", "text").mapInArrow(releasing(work), ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, a_id, b_id, n, best): links of every id pair in the corpus; best: none of its B id has more."""
    pairs = rows.where("n_a is null").select(F.explode(F.arrays_zip("codes", "counts")).alias("p"))
    pairs = pairs.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("n"))
    pairs = saved(pairs, "alignment-pairs").withColumns({"a_id": F.shiftright("code", 16), "b_id": F.col("code").bitwiseAND(65535)})
    most = pairs.groupBy(F.col("b_id").alias("_b")).agg(F.max("n").alias("_most"))
    return pairs.join(most, F.col("b_id") == F.col("_b")).select("code", "a_id", "b_id", "n", (F.col("n") == F.col("_most")).alias("best"))


def _summed(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents with n_best and count_sum. `stats`: (part, codes, counts, best), a row a part."""

    def work(batches):
        at, known = None, None
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for batch in batches:
            lists = {n: (np.asarray(batch.column(n).offsets), np.asarray(batch.column(n).values)) for n in ("codes", "counts")}
            best_at, best = np.asarray(batch.column("best").offsets), batch.column("best").values
            parts, is_doc = np.asarray(batch.column("part")), np.asarray(batch.column("n_a").is_valid())
            n_best, sums = [], []
            for i in range(batch.num_rows):
                c0, c1 = lists["codes"][0][i : i + 2]
                codes, counts = lists["codes"][1][c0:c1], lists["counts"][1][c0:c1]
                if not is_doc[i]:
                    order = np.argsort(codes)
                    at, known = parts[i], (codes[order], counts[order], np.asarray(best.slice(best_at[i], len(codes)))[order])
                    continue
                if not len(codes):
                    n_best.append(0), sums.append(0)
                    continue
                if at != parts[i]:
                    raise ValueError("documents before the pairs of their part")
                place = np.searchsorted(known[0], codes)
                n_best.append(int(counts[known[2][place]].sum())), sums.append(int((counts * known[1][place]).sum()))
            some = batch.filter(pa.array(is_doc))
            columns = [some.column("doc_id"), some.column("n_a"), some.column("n_b"), some.column("n_links"), some.column("n_links"), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), some.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names)

    nothing = F.array().cast("array<boolean>")
    both = rows.where("n_a is not null").withColumn("best", nothing).unionByName(
        stats.select(
            F.lit(None).cast("long").alias("doc_id"), "part", *[F.lit(None).cast("long").alias(c) for c in ("n_a", "n_b", "n_links")],
            F.lit(None).cast("string").alias("groups_sha256"), "codes", "counts", "best",
        )
    )
    dealt = both.repartition(partitions(rows.sparkSession), "part").sortWithinPartitions("part", F.col("n_a").isNotNull())
    return dealt.mapInArrow(releasing(work), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: tokens of both kinds, groups, links, links whose pair is the best of its B id, sum of the pairs' counts."""
    rows = saved(aligned(docs, path_a, path_b), "alignment-rows")
    counts = pair_counts(rows)
    here = rows.where("n_a is null").select("part", F.explode("codes").alias("code"))
    stats = here.join(counts.select("code", "n", "best"), "code").groupBy("part").agg(F.collect_list(F.struct("code", "n", "best")).alias("p"))
    stats = stats.select("part", F.col("p.code").alias("codes"), F.col("p.n").alias("counts"), F.col("p.best").alias("best"))
    return _summed(rows, stats)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
