"""Token ids of whole texts by a byte-level BPE, a slice of documents at a time."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The split of byte-level vocabularies before their merges.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that are encoded together.
TOKEN_SLICE = 6_000_000
#: Texts where a space meets more white space or the end cannot be cut before single spaces;
#: very long runs of white space are more than the fast encoder's patterns can go back over.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WHOLE = rf" (?:{_SPACE}|$)|{_SPACE}{{200}}"
_encoders: dict[str, "Encoder"] = {}


def byte_characters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_encoder(path: str):
    """A fast encoder of the same vocabulary and the bytes of every id, or None where merges do not follow the ids."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        saved = json.load(file)
    model, split = saved["model"], saved.get("pre_tokenizer") or {}
    if saved.get("normalizer") or saved.get("post_processor") or any(split.get(k) != v for k, v in BYTE_LEVEL.items()):
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocabulary, of = model["vocab"], byte_characters()
    order = [vocabulary["".join(m)] for m in merges]
    if order != sorted(order) or any(c not in vocabulary or vocabulary[c] >= order[0] for c in of):
        return None
    ranks = {bytes(of[c] for c in token): vocabulary[token] for token in [*of, *["".join(m) for m in merges]]}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    A byte-level BPE never joins a space to what stands before it unless white space
    follows, so texts are cut before every single space and each distinct piece of a slice
    is encoded once: all of them together as one text, whose ids are cut again where the
    bytes of the pieces end. Texts with other spacing, or with the name of a special token,
    go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = merge_encoder(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a column; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if self.fast is None:
            return self._whole(texts.to_pylist())
        whole = pc.match_substring_regex(texts, _WHOLE)
        for name in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, name))
        if not pc.any(whole, min_count=0).as_py():
            return self._pieces(texts)
        slow = iter(self._whole(texts.filter(whole).to_pylist()))
        quick = iter(self._pieces(texts.filter(pc.invert(whole))))
        return [next(slow if w else quick) for w in whole.to_pylist()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a space, and the end of every piece among them."""
        merges, sizes = self.fast
        if not len(pieces):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        all_of_them = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        ids = np.asarray(merges.encode_to_numpy(" " + pc.binary_join(all_of_them, " ")[0].as_py()), dtype="<u4")
        ends = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        return ids, np.searchsorted(np.cumsum(sizes[ids]), ends) + 1

    def _first(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.fast[0].encode_to_numpy(p) for p in pieces.to_pylist()]
        return np.concatenate([np.empty(0, "<u4"), *ids]).astype("<u4"), np.cumsum([len(i) for i in ids], dtype=np.int64)

    def _pieces(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy().astype(np.int64))
        starts = np.concatenate([[0], ends[:-1]])
        pieces = cut.flatten()
        first = np.zeros(len(pieces), dtype=bool)
        first[starts] = True
        spaced, leading = (pieces.filter(pa.array(m)).dictionary_encode() for m in (~first, first))
        code = np.empty(len(pieces), dtype=np.int64)
        code[~first] = spaced.indices.to_numpy()
        code[first] = leading.indices.to_numpy() + len(spaced.dictionary)
        (ids, cuts), (ids2, cuts2) = self._spaced(spaced.dictionary), self._first(leading.dictionary)
        known = pa.Array.from_buffers(
            pa.large_binary(),
            len(cuts) + len(cuts2),
            [
                None,
                pa.py_buffer(np.concatenate([[0], cuts, len(ids) + cuts2]).astype(np.int64) * 4),
                pa.py_buffer(np.concatenate([ids, ids2])),
            ],
        )
        found = known.take(pa.array(code))
        # The ids of a text are those of its pieces, which lie side by side.
        bounds = np.frombuffer(found.buffers()[1], np.int64)[found.offset :]
        data = found.buffers()[2]
        return [data[int(bounds[a]) : int(bounds[b])].to_pybytes() for a, b in zip(starts, ends, strict=True)]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, made once per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
