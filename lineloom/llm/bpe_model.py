"""A byte-pair vocabulary read from a tokenizer file: merges, pair checks and exact merging.

Merging takes the lowest-ranked pair again and again, so everything a merge needs has a lower rank
than the merge itself. A token is therefore there for a span of ranks: from the merge that makes it
to the merge that uses it. Two tokens may stand side by side in an encoding exactly if no merge
across their border falls into the time in which both of its parts are there. A sequence of
reachable tokens is the encoding of its bytes exactly if this holds for each adjacent pair.
"""

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: How byte-level vocabularies write bytes that are no visible characters.
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Fixed value: the split of byte-level vocabularies that give no pattern of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the split of the vocabulary with word ends, as its file has it.
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which the built-in patterns below mean the same as the two above.
LATIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
LATIN_SPLITS = {
    BYTE_LEVEL: r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
    WORD_ENDS: r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+",
}

FAR = np.iinfo(np.int64).max
SLOT_BITS = 20


def _byte_names() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in VISIBLE]
    return {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeModel:
    """One tokenizer file. ``words(text)`` splits, ``exact(word)`` encodes, ``fits(left, right)`` checks pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, names = spec["model"], _byte_names()
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.plain: dict[bytes, int] = {}
        self.ended: dict[bytes, int] = {}
        self.spelled: list[bytes] = [b""] * self.size
        for name, token in vocab.items():
            closed = bool(self.end) and name.endswith(self.end)
            spelled = bytes(names[c] for c in (name[: -len(self.end)] if closed else name))
            (self.ended if closed else self.plain)[spelled] = token
            self.spelled[token] = spelled
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, token in self.special.items():
            self.spelled[token] = text.encode()
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        keys, ranks = [], []
        for rank, (a, b) in enumerate(pairs):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.rank[made] >= 0 or max(self.rank[x], self.rank[y]) >= rank:
                raise ValueError("merges are not in the order in which they build on each other")
            self.left[made], self.right[made], self.rank[made] = x, y, rank
            keys.append(x * self.size + y)
            ranks.append((rank, made))
        self.merges = dict(zip(keys, ranks))
        order = np.argsort(keys)
        self._keys = np.array(keys, np.int64)[order]
        self._ranks = np.array([r for r, _ in ranks], np.int64)[order]
        self._products = np.array([m for _, m in ranks], np.int64)[order]
        self._letter_tokens = np.array([self.plain[bytes([b])] for b in range(256)], np.int64)
        if self.end:
            self._letter_ends = np.array([self.ended[bytes([b])] for b in range(256)], np.int64)
        self._slot_keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self._slot_answers = np.zeros(1 << SLOT_BITS, bool)
        self._reachable()
        self._build_trie()
        self.longest = max(map(len, [*self.plain, *self.ended]))
        steps = spec.get("normalizer") or {}
        self.normalised = bool(steps)
        if steps and [s["type"] for s in steps.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("normalizer is not supported")
        first = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])[0]
        pattern = first["pattern"]["Regex"] if first["type"] == "Split" else BYTE_LEVEL
        self._split = regex.compile(pattern).findall
        self._latin_split = re.compile(LATIN_SPLITS[pattern]).findall if pattern in LATIN_SPLITS else self._split
        self._path, self._bytes, self._odd = path, names, {}
        self._apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def _merge_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; beyond all ranks where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], FAR)

    def stable(self, left: np.ndarray, right: np.ndarray, skip_first: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of each pair of tokens.

        Going back in time, the token made last is undone first; what then stands at the border are
        its right or its left part. Of two made by one merge the right one is undone first, as
        merging goes from the left. ``skip_first`` leaves the whole tokens themselves out.
        """
        held = np.ones(len(left), bool)
        lanes, x, y = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        x_used, y_used = np.full(len(x), FAR), np.full(len(x), FAR)
        while len(lanes):
            if not skip_first:
                rank = self._merge_ranks(x, y)
                broken = (rank < x_used) & (rank <= y_used) & (rank < FAR)
                held[lanes[broken]] = False
                on = ~broken & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
                lanes, x, y, x_used, y_used = lanes[on], x[on], y[on], x_used[on], y_used[on]
            skip_first = False
            undo = self.rank[x] > self.rank[y]
            x_used, y_used = np.where(undo, self.rank[x], x_used), np.where(undo, y_used, self.rank[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return held

    def _reachable(self) -> None:
        """Tokens that merging never gives are taken out of the two spellings."""
        made = np.argsort(self.rank)
        made = made[self.rank[made] >= 0]
        fine = np.ones(self.size, bool)
        fine[made] = self.stable(self.left[made], self.right[made], skip_first=True)
        for token in made:
            fine[token] &= fine[self.left[token]] and fine[self.right[token]]
        for spelling in (self.plain, self.ended):
            for spelled in [s for s, t in spelling.items() if not fine[t]]:
                del spelling[spelled]

    def fits_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stable`` with a table of answers given before, one per slot."""
        key = left * self.size + right
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        missing = np.flatnonzero(self._slot_keys[slot] != key)
        out = self._slot_answers[slot]
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            answers = self.stable(new // self.size, new % self.size)
            out[missing] = answers[back]
            self._slot_keys[slot[missing]] = key[missing]
            self._slot_answers[slot[missing]] = out[missing]
            # Of several new keys of one slot the last written stays; its answer must be its own.
            clash = missing[self._slot_keys[slot[missing]] != key[missing]]
            self._slot_keys[slot[clash]] = -1
        return out

    def fits(self, left: int, right: int) -> bool:
        """``stable`` for one pair."""
        return bool(self.fits_many(np.array([left], np.int64), np.array([right], np.int64))[0])

    def open_counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the encoding of every prefix of every word, by dynamic programming.

        Prefixes of the words lie one after another, the empty one first; a proper prefix counts as
        text that goes on, the whole word as one that ends. From a prefix whose last token is known, every
        token that may stand next gives the last token of a longer prefix; each prefix gets exactly one.
        Returns the counts and the place of each word's whole.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        stop, number = np.repeat(ends, sizes), np.repeat(np.arange(len(words)), sizes)
        places, lengths, tokens = [], [], []
        for length, at, token in self.found(letters, stop):
            places.append(at)
            lengths.append(np.full(len(at), length))
            tokens.append(token)
        if not places:
            return np.zeros(len(words), np.int64), np.arange(len(words))
        at, length, token = map(np.concatenate, (places, lengths, tokens))
        depth = at - (ends - sizes)[number[at]]
        order = np.argsort(depth, kind="stable")
        begin, length, token, depth = (at + number[at])[order], length[order], token[order], depth[order]
        last, counts = np.zeros(len(letters) + len(words), np.int64), np.zeros(len(letters) + len(words), np.int64)
        cuts = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)]):
            start, reach, new = begin[low:high], length[low:high], token[low:high]
            if depth[low]:
                fine = self.fits_many(last[start], new)
                start, reach, new = start[fine], reach[fine], new[fine]
            last[start + reach] = new
            counts[start + reach] = counts[start] + 1
        return counts, ends + np.arange(len(words))

    def segments(self, text: str) -> list[str]:
        """The text cut at strings of special tokens, which stand as parts of their own."""
        if self._apart is None or not any(s in text for s in self.special):
            return [text]
        return [part for part in self._apart(text) if part]

    def normalise(self, text: str) -> str:
        if not self.normalised:
            return text
        # Lower case is taken character by character: the last sigma of a word is no other letter.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, segment: str) -> list[str]:
        """The pieces of a segment within which merging takes place; a special string is one piece."""
        if segment in self.special:
            return [segment]
        if LATIN.fullmatch(segment):
            return self._latin_split(self.normalise(segment))
        rare = {c for c in segment if c > "\u024f"}
        if any(self._differs(c) for c in rare):
            return self._by_library(segment)
        return self._split(self.normalise(segment))

    @property
    @lru_cache(1)
    def _library(self) -> Tokenizer:
        return Tokenizer.from_file(self._path)

    def _by_library(self, segment: str) -> list[str]:
        """The library's own split."""
        steps = self._library
        plain = steps.normalizer.normalize_str(segment) if steps.normalizer else segment
        pieces = steps.pre_tokenizer.pre_tokenize_str(plain)
        return [bytes(self._bytes[c] for c in piece).decode() for piece, _ in pieces]

    def _differs(self, character: str) -> bool:
        """Whether the library has a character in another class than the patterns here.

        The Unicode versions of the two differ. Each character is tried once in a worker.
        """
        known = self._odd.get(character)
        if known is None:
            probe = f"a{character}b {character} 1{character}\n{character}x {character}{character}"
            known = self._odd[character] = self._by_library(probe) != self._split(self.normalise(probe))
        return known

    def _build_trie(self) -> None:
        """All spellings as one trie in arrays: children by (node, byte), and the token that ends at a node."""
        nodes: dict[tuple[int, int], int] = {}
        plain, ended = [-1], [-1]
        for spelling, at in ((self.plain, plain), (self.ended, ended)):
            for spelled, token in spelling.items():
                node = 0
                for byte in spelled:
                    node = nodes.setdefault((node, byte), len(nodes) + 1)
                    if node == len(plain):
                        plain.append(-1)
                        ended.append(-1)
                at[node] = token
        keys = np.array([n * 256 + b for n, b in nodes], np.int64)
        order = np.argsort(keys)
        self._edge_keys, self._edge_nodes = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self._plain_at, self._ended_at = np.array(plain, np.int64), np.array(ended, np.int64)
        self._first = np.zeros(256, np.int64)
        self._first[[b for n, b in nodes if n == 0]] = [v for (n, _), v in nodes.items() if n == 0]

    def found(self, letters: np.ndarray, stop: np.ndarray):
        """Tokens that start at each place of words that lie one after another, by growing length.

        ``stop`` is the end of the word of each place. Gives ``(length, places, tokens)``; a token with
        a word end only where the word ends, one without only where it doesn't (or where there are none).
        """
        at, node, length = np.arange(len(letters)), self._first[letters], 1
        while len(at):
            closing = at + length == stop[at]
            if self.end:
                token = np.where(closing, self._ended_at[node], self._plain_at[node])
            else:
                token = self._plain_at[node]
            there = token >= 0
            yield length, at[there], token[there]
            on = ~closing
            at, key = at[on], node[on] * 256 + letters[at[on] + length]
            edge = np.minimum(np.searchsorted(self._edge_keys, key), len(self._edge_keys) - 1)
            hit = self._edge_keys[edge] == key
            at, node, length = at[hit], self._edge_nodes[edge[hit]], length + 1

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens from the left, for all words at once: tokens, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        reach, token = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
        for length, at, tokens in self.found(letters, stop):
            reach[at], token[at] = length, tokens
        taken = np.zeros(len(letters), bool)
        at, last = ends - sizes, ends
        while len(at):
            taken[at] = True
            at = at + reach[at]
            inside = at < last
            at, last = at[inside], last[inside]
        counts = np.add.reduceat(taken, ends - sizes, dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        return token[taken], counts

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word makes its next merge."""
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, w in enumerate(words) if len(w) <= 64]
        for i in set(range(len(words))) - set(short):
            out[i] = self.exact(words[i])
        sizes = np.array([len(words[i]) for i in short], np.int64)
        letters = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        symbols, own = self._letter_tokens[letters], np.repeat(np.array(short, np.int64), sizes)
        if self.end:
            last = np.cumsum(sizes) - 1
            symbols[last] = self._letter_ends[letters[last]]

        def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and product of the pair that starts at each place."""
            follows = np.minimum(at + 1, len(symbols) - 1)
            key = symbols[at] * self.size + symbols[follows]
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            there = (self._keys[place] == key) & (own[at] == own[follows]) & (follows > at)
            return np.where(there, self._ranks[place], FAR), np.where(there, self._products[place], -1)

        rank, made = look(np.arange(len(symbols))) if len(symbols) else (symbols, symbols)
        while len(symbols):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(own)))
            ready = np.repeat(least == FAR, lengths)
            if ready.any():
                tokens = symbols[ready].tolist()
                at = 0
                for start, length in zip(first[least == FAR].tolist(), lengths[least == FAR].tolist()):
                    out[own[start]] = tokens[at : at + length]
                    at += length
                symbols, own, rank, made = symbols[~ready], own[~ready], rank[~ready], made[~ready]
                least, lengths = least[least < FAR], lengths[least < FAR]
                if not len(symbols):
                    break
            lowest = np.flatnonzero(rank == np.repeat(least, lengths))
            at = lowest[np.append(True, own[lowest][1:] != own[lowest][:-1])]
            symbols[at] = made[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            at = at - np.arange(len(at))
            symbols, own, rank, made = symbols[kept], own[kept], rank[kept], made[kept]
            changed = np.concatenate([at, at[at > 0] - 1])
            rank[changed], made[changed] = look(changed)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, the leftmost of equals first, with a heap over a linked list."""
        if not word:
            return []
        symbols = [self.plain[word[i : i + 1]] for i in range(len(word))]
        if self.end:
            symbols[-1] = self.ended[word[-1:]]
        merges, size, count = self.merges, self.size, len(symbols)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = []
        for i in range(count - 1):
            merge = merges.get(symbols[i] * size + symbols[i + 1])
            if merge:
                heap.append((merge[0], i, symbols[i], symbols[i + 1], merge[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != x or j >= count or symbols[j] != y:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[i] < count:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < count and (merge := merges.get(symbols[a] * size + symbols[b])):
                    heapq.heappush(heap, (merge[0], a, symbols[a], symbols[b], merge[1]))
        return [s for s in symbols if s >= 0]


@lru_cache(4)
def model(path: str) -> BpeModel:
    """The model of a file, once in each worker."""
    return BpeModel(path)
