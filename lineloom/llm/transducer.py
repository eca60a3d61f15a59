"""Minimal acyclic transducers from sorted terms to their ordinals, and streaming many words through one at once."""

import numpy as np


class _State:
    __slots__ = ("final", "arcs", "number", "terms")

    def __init__(self):
        self.final, self.arcs, self.number, self.terms = False, [], -1, 0


class Transducer:
    """Arcs as sorted arrays: key ``state << 8 | byte``, the state an arc leads to, and what it adds to the ordinal."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, finals: np.ndarray):
        self.keys, self.targets, self.adds, self.finals = keys, targets, adds, finals
        self.root = len(finals) - 1

    @classmethod
    def of_sorted(cls, terms: list[bytes]) -> "Transducer":
        """Built term by term in ascending order: what the next term cannot share any more is frozen, equal states
        becoming one. A state knows how many terms end below it, so an arc adds those of its earlier sisters."""
        keys: list[int] = []
        targets: list[int] = []
        adds: list[int] = []
        finals: list[bool] = []
        known: dict[tuple, _State] = {}

        def number(state: _State) -> None:
            state.number, before = len(finals), int(state.final)
            finals.append(state.final)
            for byte, target in state.arcs:
                keys.append(state.number << 8 | byte)
                targets.append(target.number)
                adds.append(before)
                before += target.terms
            state.terms = before

        def freeze(path: list[_State], depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                sign = (state.final, tuple((byte, target.number) for byte, target in state.arcs))
                twin = known.get(sign)
                if twin is None:
                    number(state)
                    known[sign] = twin = state
                parent = path[-1]
                parent.arcs[-1] = (parent.arcs[-1][0], twin)

        path, last = [_State()], b""
        for term in terms:
            shared = 0
            while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
                shared += 1
            freeze(path, shared)
            for byte in term[shared:]:
                state = _State()
                path[-1].arcs.append((byte, state))
                path.append(state)
            path[-1].final = True
            last = term
        freeze(path, 0)
        number(path[0])
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array(finals, bool))

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.keys.tobytes(), self.targets.tobytes(), self.adds.tobytes(), self.finals.tobytes()

    @classmethod
    def from_bytes(cls, keys: bytes, targets: bytes, adds: bytes, finals: bytes) -> "Transducer":
        kinds = (np.int64, np.int32, np.int32, bool)
        return cls(*[np.frombuffer(part, kind) for part, kind in zip((keys, targets, adds, finals), kinds)])

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinals of the words ``data[start : start + length]``, -1 for those that are no term; all move on together."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        word, at, left = np.arange(len(starts)), starts.astype(np.int64), lengths.copy()
        state, ordinal = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        while len(word):
            arc_key = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(self.keys, arc_key), len(self.keys) - 1)
            fits = self.keys[arc] == arc_key
            arc, word, at, left, ordinal = arc[fits], word[fits], at[fits] + 1, left[fits] - 1, ordinal[fits]
            state = self.targets[arc].astype(np.int64)
            ordinal = ordinal + self.adds[arc]
            ended = left == 0
            accepted = ended & self.finals[state]
            out[word[accepted]] = ordinal[accepted]
            on = ~ended
            word, at, left, state, ordinal = word[on], at[on], left[on], state[on], ordinal[on]
        return out
