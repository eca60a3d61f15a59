"""The walk over pieces, next to a plain loop over one piece at a time."""

import random
from itertools import accumulate

import pyarrow as pa

from lineloom.operators.extract_js import BITS, EXPORTED, PLACED, SOFT, UNREAD, _walked

PIECES = pa.list_(pa.struct([("line", pa.int32()), ("piece", pa.string()), ("flags", pa.int32())]))
BLANK = {end: " \t\r" + end for end in ("", "{", "}", ";")}


def _walk(lines: list[int], pieces: list[str], flags: list[int]):
    """The places of the pieces of one file, one by one."""
    b = BITS
    heads = {}
    lists = {}
    blocks = {}
    depth = inside = hidden = soft = offset = last_line = 0
    before, last = ";", 0
    for at, (line, piece, f) in enumerate(zip(lines, pieces, flags, strict=True), 1):
        if line != last_line:
            last_line, offset = line, 0
        end = piece[-1] if piece[-1] in "{};" else ""
        blank = not piece.strip(BLANK[end])
        brackets = piece.count("(") + piece.count("[") - piece.count(")") - piece.count("]")
        # A lone opening brace after a closing one is the body after an object type.
        after_type = blank and end == "{" and before == "}"
        goes_on = blank or f & b["goes_on"]
        starts = inside == 0 and (not (goes_on or last & b["carried"]) or (before != "" and not after_type))
        # A list of declarators goes on after a comma, also after a block.
        comma = inside == 0 and (last & b["after_comma"] != 0 or piece.lstrip(" \t\n\v\f\r").startswith(","))
        if starts:
            heads[depth] = at, soft, offset
            if not comma:
                lists[depth] = at
        head, head_soft, head_offset = heads.get(depth, (0, 0, 0))
        listed = lists.get(depth, 0)
        kind, block = blocks.get(depth, ("", 0))
        visible = depth >= 0 and hidden == 0
        in_class = depth >= 0 and hidden == 1 and kind == "C"
        if (visible or in_class) and (starts or end == "{" or (listed and flags[listed - 1] & b["variable"])):
            around = block if depth > 0 else 0
            places = (at, head, listed, around, soft, offset, head_soft, head_offset, inside, brackets)
            yield (*places, starts, comma, before == "}", visible, in_class)
        if end == "{":
            own = flags[head - 1] if head and inside + brackets == 0 else 0
            kind, block = "B", UNREAD
            if own & b["function"] and f & b["typed"]:
                pass
            elif own & b["by_default"] and (own & b["function"] or f & b["arrow"]):
                kind, block = "X", EXPORTED
            elif own & b["named"] and own & b["function"]:
                kind, block = "F", head
            elif own & b["named"] and own & b["class"] and not own & b["by_default"]:
                kind, block = "C", head
            depth += 1
            blocks[depth] = kind, block
            hidden += kind in ("B", "C")
        elif end == "}":
            hidden -= kind in ("B", "C")
            depth -= 1
        inside += brackets
        cuts = piece.count(SOFT)
        soft += cuts
        offset = len(piece) - 1 - piece.rindex(SOFT) if cuts else offset + len(piece)
        before, last = end, f


def _file(rng):
    """Pieces of any kind: unbalanced, blank, with soft line ends and characters of several bytes."""
    size = rng.choice([0, 1, 2, 5, 20, 60])
    lines = list(accumulate((rng.choice([0, 0, 1, 2]) for _ in range(size)), initial=1))[:size]
    body = lambda: "".join(rng.choices(["(", ")", "[", "]", " ", "a", ",", SOFT, "é", "\t", "x = 1", "\U00010400"], k=rng.randint(0, 4)))
    plain = lambda text: "".join(c for c in text if c not in "()[]") if rng.random() < 0.5 else text
    pieces = [(plain(body()) + rng.choice(["{", "}", "}", "{", ";", ""])) or "q" for _ in lines]
    return lines, pieces, [sum(bit for bit in BITS.values() if rng.random() < 0.3) for _ in lines]


def test_walk_over_a_batch_gives_what_a_loop_over_each_file_gives():
    rng = random.Random(7)
    kinds = [bool if kind == "boolean" else int for kind in PLACED.values()]
    for turn in range(300):
        files = [_file(rng) for _ in range(rng.choice([0, 1, 3, 8]))]
        batch = pa.array([[{"line": n, "piece": p, "flags": f} for n, p, f in zip(*file)] for file in files], PIECES)
        if turn % 2 and files:
            files, batch = files[1:], batch.slice(1)
        found = [[tuple(row.values()) for row in rows] for rows in _walked(batch).to_pylist()]
        assert found == [[tuple(k(v) for k, v in zip(kinds, row)) for row in _walk(*file)] for file in files]
