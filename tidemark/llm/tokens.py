"""Encoding texts with public tokenizers; vocabulary files are found by path, a parameter everywhere."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 1 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ids(path: str) -> np.ndarray:
    """All ids of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return np.array([int(line.split()[1]) for line in f])


@functools.cache
def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a tiktoken vocabulary file; strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.asarray(own.encode_to_numpy(text, disallowed_special=()), np.uint32)


class WordEncoder:
    """Ids of texts by a lower-casing tokenizers file whose pieces never cross white space or join letters and signs.

    Equal to encoding whole texts: texts without combining marks are lower-cased in A-Z; texts are cut at spaces, line feeds and tabs, and before a
    full stop or comma that follows a letter A-Z and ends a chunk. Arrow cuts the texts and finds the different chunks. The ids of a chunk are kept
    and used again; new chunks are encoded by the library, many in one string: chunks of letters side by side, as each is one
    word, whose last id is one of a word's end; others with a sign of its own between them.
    """

    SIGN, TOGETHER = "~", 500
    STOP = re.compile(r"(?<=[A-Za-z])[.,](?=[ \n\t])")
    MARK = re.compile("[\u0300-\u036f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        (self.sign_id,) = self._ids(self.SIGN).tolist()
        self.size = self.own.get_vocab_size()
        self.last = np.zeros(self.size, bool)  # ids that end a word
        self.last[[i for word, i in self.own.get_vocab(with_added_tokens=False).items() if word.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)

    def _chunks(self, text: str) -> list[str]:
        if "<|" in text:  # perhaps a special token, whose letters' case counts
            return [text]
        if not self.MARK.search(text):  # some marks compose with small letters only
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return self.STOP.sub(r" \g<0>", text).replace("\n", " ").replace("\t", " ").split(" ")

    def _cut(self, texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
        """The different chunks, the place among them of each text's chunks, and how many chunks each text has; as ``_chunks``."""
        low = pc.ascii_lower(texts)
        for space in "\n\t":
            low = pc.replace_substring(low, space, " ")
        parts = pc.split_pattern(pc.replace_substring_regex(low, r"([a-z])([.,]) ", r"\1 \2 "), " ")
        different = parts.flatten().dictionary_encode()
        return different.dictionary.to_numpy(zero_copy_only=False).tolist(), different.indices, pc.list_value_length(parts).to_numpy()

    def _keep(self, new: list[str]) -> dict[str, bytes]:
        """Takes new chunks' ids into ``seen``; returns those of chunks that are not kept."""
        odd = [c for c in new if "<|" in c or self.SIGN in c]
        plain = [c for c in new if not ("<|" in c or self.SIGN in c)] if odd else new
        words = [c for c in plain if c.isalpha()]
        for between, many in ((" ", words), (f" {self.SIGN} ", [c for c in plain if not c.isalpha()])):
            groups = [many[i : i + self.TOGETHER] for i in range(0, len(many), self.TOGETHER)]
            for group, got in zip(groups, self.own.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(got.ids, np.uint32)
                if between == " ":
                    ends = np.flatnonzero(self.last[ids]) + 1
                    if len(ends) != len(group):  # letters that the library does not take for one word
                        self.seen.update((c, self._ids(c).tobytes()) for c in group)
                        continue
                    starts = np.append(0, ends[:-1])
                else:
                    ends = np.append(np.flatnonzero(ids == self.sign_id), len(ids))
                    starts = np.append(0, ends[:-1] + 1)
                raw = ids.tobytes()
                self.seen.update((c, raw[a:b]) for c, a, b in zip(group, (4 * starts).tolist(), (4 * ends).tolist(), strict=True))
        return {c: self._ids(c).tobytes() for c in odd}

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:  # what came early is mostly what comes often
            self.seen = dict(itertools.islice(self.seen.items(), CACHE // 2))
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\\x{300}-\\x{36f}]"))
        different, place, counts = self._cut(texts.filter(pc.invert(odd)))
        rare = [self._chunks(t) for t in texts.filter(odd).to_pylist()]
        seen = self.seen
        once = self._keep(sorted({c for c in itertools.chain(different, *rare) if c not in seen}))
        found = [once[c] if c in once else seen[c] for c in different] if once else [seen[c] for c in different]
        taken = pa.array(found, pa.large_binary()).take(place)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // 4
        flat = np.frombuffer(taken.buffers()[2] or b"", np.uint32, ends[-1])
        edges = ends[np.append(0, np.cumsum(counts))].tolist()
        usual = iter([flat[a:b] for a, b in itertools.pairwise(edges)])
        others = iter([np.frombuffer(b"".join(once[c] if c in once else seen[c] for c in cs), np.uint32) for cs in rare])
        return [next(others) if x else next(usual) for x in odd.to_pylist()]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each path and worker process, so that tasks after the first find frequent chunks known."""
    return WordEncoder(path)
