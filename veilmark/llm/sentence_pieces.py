"""SentencePiece encoding and decoding by a fast backend that is rebuilt from the model's protobuf.

The model file is parsed here; its normaliser, metaspace marker, pieces with scores and byte fallback are
set up in the `tokenizers` library, whose threads encode and decode batches. Ids and decoded texts are this
backend's. `parity` tells whether the model's own library gives the same ids, so rows where the two differ (ties between equal
merges in runs of one sign) can be told; `faithful` takes the library's ids for these. Where words are
apart in the model, the unit of a batch is the distinct word, which is encoded, decoded and verified once
while it is kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
RUNS = re.compile(" +[^ ]*")
#: Words that are encoded as one text.
LOT = 64


def rebuild(model_file: str):
    """A tokenizers.Tokenizer of the same pieces: Unigram with scores, or BPE with merges ordered by score."""
    import sentencepiece.sentencepiece_model_pb2 as pb
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = pb.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    trainer, rule = proto.trainer_spec, proto.normalizer_spec
    unk = next((i for i, p in enumerate(proto.pieces) if p.type == 2), None)
    if trainer.model_type == 1:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk, trainer.byte_fallback)
    elif trainer.model_type == 2:
        ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        real = {p.piece: p.score for p in proto.pieces if p.type in (1, 4, 5)}
        pairs = [(-s, i, p[:i], p[i:]) for p, s in real.items() for i in range(1, len(p)) if p[:i] in real and p[i:] in real]
        pairs.sort(key=lambda x: (x[0], ids[x[2] + x[3]], x[1]))
        model = models.BPE(ids, [(a, b) for *_, a, b in pairs], unk_token=proto.pieces[unk].piece if unk is not None else None, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError("the model is neither unigram nor BPE")
    out = Tokenizer(model)
    steps = []
    if rule.precompiled_charsmap:
        steps.append(normalizers.Precompiled(rule.precompiled_charsmap))
    if rule.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rule.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (1, 4, 5)):  # words are apart, so they can be cached
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if rule.add_dummy_prefix else [])])
    return out


class Codec:
    """Encodes and decodes by the rebuilt backend and verifies it against the model's own library.

    Where the model keeps words apart (identity normaliser, no piece with a marker behind a letter), each
    distinct word is worked on once while it is kept, and a text's ids are those of its words; else whole texts are.
    Words are kept in two generations of `kept_words` / 2: at the bound the older one goes, which changes no result.
    """

    def __init__(self, model_file: str, threads: int, kept_words: int = 300_000, faithful: bool = False):
        import sentencepiece
        import sentencepiece.sentencepiece_model_pb2 as pb

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.fast = rebuild(model_file)
        self.own = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.threads, self.bound, self.faithful = threads, kept_words // 2, faithful
        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rule = proto.normalizer_spec
        self.by_word = rule.add_dummy_prefix and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.lone = np.array([self.own.piece_to_id(MARK)], np.int32).tobytes()  # a marker alone, which an empty text hasn't
        self.marked = np.array([p.piece.startswith(MARK) for p in proto.pieces])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.lossy: set[str] = set()

    def whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """The backend's ids, whether the own library's are the same, and whether they decode to the text."""
        got = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.own.encode(texts, num_threads=self.threads)
        same = [a == b for a, b in zip(got, want)]
        if self.faithful:
            got = want
        return got, same, [a == b for a, b in zip(self.decode(got), texts)]

    def lots(self, words: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Like whole() for words without blanks, many at once: a lot is a text, whose ids are cut before pieces with a marker."""
        texts = [" ".join(words[k : k + LOT]) for k in range(0, len(words), LOT)]
        ids, same, back = self.whole(texts)
        flat = np.concatenate([np.array(x, np.int32) for x in ids])
        starts = np.flatnonzero(self.marked[flat])
        if len(starts) != len(words):  # a marker inside a lot isn't one word's start
            ids, ok, told = self.whole(words)
            return [np.array(x, np.int32).tobytes() for x in ids], ok, told
        raw, ends = flat.tobytes(), np.append(starts[1:], len(flat)).tolist()
        pieces = [raw[4 * a : 4 * e] for a, e in zip(starts.tolist(), ends)]
        ok, told = [True] * len(words), [True] * len(words)
        for k in range(len(texts)):
            if not (same[k] and back[k]):  # which words of the lot it is
                at = range(k * LOT, min((k + 1) * LOT, len(words)))
                got, ok_one, told_one = self.whole([words[i] for i in at])
                for i, x, y, z in zip(at, got, ok_one, told_one):
                    pieces[i], ok[i], told[i] = np.array(x, np.int32).tobytes(), y, z
        return pieces, ok, told

    def learn(self, words: list[str]) -> None:
        """Encodes, verifies and decodes words that aren't kept."""
        odd = [w for w in words if " " in w]
        words = [w for w in words if " " not in w] if odd else words
        ids, same, back = self.lots(words) if words else ([], [], [])
        if odd:
            more, same_odd, back_odd = self.whole(odd)
            words, ids, same, back = words + odd, ids + [np.array(x, np.int32).tobytes() for x in more], same + same_odd, back + back_odd
        self.young.update(zip(words, ids))
        self.differing.update(w for w, ok in zip(words, same) if not ok)
        self.lossy.update(w for w, ok in zip(words, back) if not ok)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, list[bool], list[bool]]:
        """Ids, parity and round trip of each text."""
        if not self.by_word:
            ids, same, back = self.whole(texts)
            return pa.array(ids, pa.list_(pa.int32())), same, back
        split = [self.words(t) for t in texts]
        here = set().union(*split)
        here.discard("")
        new = here.difference(self.young)
        if len(self.young) + len(new) > self.bound:
            self.old, self.young, new = self.young, {}, here
            self.differing.intersection_update(self.old)
            self.lossy.intersection_update(self.old)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        self.learn(list(new.difference(again)))
        self.young[""] = self.lone
        get, bad, lossy = self.young.__getitem__, self.differing, self.lossy
        joined = [b"".join(map(get, ws)) for ws in split]
        ends = np.zeros(len(joined) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in joined], out=ends[1:])
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(joined), np.int32)))
        same = [not bad or bad.isdisjoint(ws) for ws in split]
        # Words are joined by the blanks that the markers stand for; a marker in the text itself comes back as a blank.
        back = [MARK not in t and (not lossy or lossy.isdisjoint(ws)) for t, ws in zip(texts, split)]
        return ids, same, back

    @staticmethod
    def words(text: str) -> list[str]:
        """Each word without its first marker, as a text of its own."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        return text.split(" ") if "  " not in text and text[0] != " " else [w[1:] for w in RUNS.findall(" " + text)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(model_file: str, threads: int, faithful: bool = False) -> Codec:
    return Codec(model_file, threads, faithful=faithful)


def parts(texts: list[str], chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of about so many characters, for bounded memory with very long texts."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, model_file: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), faithful: bool = False) -> DataFrame:
    """The id, columns in `keep`, token_ids array<int>, n_tokens, parity, round_trip.

    token_ids are the rebuilt backend's; with `faithful`, rows without parity have the own library's. parity: both
    agree. round_trip: the ids decode to the text. A null text gives an empty array like an empty one; ids
    may be null or repeated; rows stay one for one, other columns go; an empty table gives an empty one. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, threads, faithful)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s in parts(texts):
                ids, same, back = c.encode(texts[s])
                columns = [b.column(0)[s], *(b.column(k)[s] for k in range(2, b.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, ids, ids.value_lengths().cast(pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())],
                    [id_col, *keep, "token_ids", "n_tokens", "parity", "round_trip"],
                )

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(id_col, text_col, *keep).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}{extra}, token_ids array<int>, n_tokens bigint, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model_file: str, threads: int = 2, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The id and the text of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file, threads)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.decode([x or [] for x in b.column(1).to_pylist()]), pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")
