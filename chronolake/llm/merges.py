"""Byte-pair merges compiled into a deterministic transducer whose transitions carry emitted-token counts.

The encoding of a prefix of a pretoken ends in one token, and only one token that ends a text fits what
stands before it: the one that no merge could join or split across its front.  So whether tokens follow
each other is a matter of pairs (``fits``), and the encoding grows byte by byte: the token that ends at a
byte is the one suffix that is in the vocabulary and fits the token that ends where it begins.

A state is what later bytes can depend on: the longest suffix that begins a token of the vocabulary, with
the last token and the count (from here) at each of its places.  There are finitely many.  A transition
leads to the next state and carries by how many tokens the encoding grows (less than 0 if merges swallow
some).  States and transitions are made when they are first met, and let go when there are MOST of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Transitions that are kept at most: about 120 MB.
MOST = 250_000
NONE = -1
#: A transition is its state above these bits and its count, from the middle of their range, in them.
BITS = 12
MIDDLE = 1 << BITS - 1


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for one: visible ones for themselves, the others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTransducer:
    """Counts the tokens of pretokens. path: a tokenizer's file with a byte-level BPE without options."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("not a plain byte-level BPE")
        alphabet = byte_alphabet()
        raw = lambda token: bytes([alphabet[c] for c in token])
        self.tokens = [raw(t) for t in model["vocab"] if all(c in alphabet for c in t)]
        self.number = {t: k for k, t in enumerate(self.tokens)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((self.number[a], self.number[b]), (k, self.number[a + b]))
        self.begins = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        self._edges: dict[tuple[int, bool], list[tuple[int, int]] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (b"", (NONE,), (0,))
        self.states, self.known = [start], {start: 0}
        self.steps: dict[int, int] = {}

    def _process(self, text: bytes) -> Iterator[list[tuple[int, int]]]:
        """The merge process itself: the tokens of text after each merge, each with the rank at which it came to be."""
        parts, none = [(self.number[text[k : k + 1]], NONE) for k in range(len(text))], (len(self.rank) + 1, NONE)
        yield parts
        while len(parts) > 1:
            (rank, token), at = min((self.rank.get((a, b), none), k) for k, ((a, _), (b, _)) in enumerate(zip(parts, parts[1:])))
            if token == NONE:
                break
            parts[at : at + 2] = [(token, rank)]
            yield parts

    def merged(self, text: bytes) -> list[int]:
        *_, parts = self._process(text)
        return [token for token, _ in parts]

    def edges(self, token: int, right: bool) -> list[tuple[int, int]] | None:
        """What stands at an end of a token while its bytes are merged, from the whole token down to a byte,
        each with the rank at which it comes to be. None if the bytes don't give the token; an empty list if
        the merges don't come in order of rank."""
        key = (token, right)
        if key not in self._edges:
            end, out = -1 if right else 0, []
            for parts in self._process(self.tokens[token]):
                if not out or parts[end] != out[-1]:
                    out.append(parts[end])
            steady = all(a < b for (_, a), (_, b) in zip(out, out[1:]))
            self._edges[key] = None if len(parts) > 1 else out[::-1] if steady else []
        return self._edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, next to each other, give just these two tokens."""
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            found = self._fits[key] = self._fit(left, right)
        return found

    def _fit(self, left: int, right: int) -> bool:
        ends = self.edges(right, False)
        if ends is None:
            return False
        if left == NONE:
            return True
        fronts = self.edges(left, True)
        if fronts is None:
            return False
        if not fronts or not ends:  # ask the process itself
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        i, j, last = len(fronts) - 1, len(ends) - 1, len(self.rank) + 1
        while True:  # from the bytes up to the whole tokens
            goes_left = fronts[i - 1][1] if i else last
            goes_right = ends[j - 1][1] if j else last
            rank = self.rank.get((fronts[i][0], ends[j][0]), (last, 0))[0]
            # of equal ranks the leftmost pair is merged first
            if rank < last and rank < goes_left and rank <= goes_right:
                return False
            if goes_left == goes_right == last:
                return True
            if goes_left <= goes_right:
                i -= 1
            if goes_right <= goes_left:
                j -= 1

    def _compile(self, state: int, byte: int) -> int:
        text, last, count = self.states[state]
        grown = text + bytes([byte])
        for k in range(len(text) + 1):
            token = self.number.get(grown[k:])
            if token is not None and self.fits(last[k], token):
                break
        else:
            raise ValueError(f"no token ends {grown!r}")
        delta = count[k] + 1
        cut = next(k for k in range(len(grown) + 1) if grown[k:] in self.begins)
        new = (grown[cut:], (*last, token)[cut:], tuple(c - delta for c in (*count, delta))[cut:])
        to = self.known.get(new)
        if to is None:
            to = self.known[new] = len(self.states)
            self.states.append(new)
        step = self.steps[state << 8 | byte] = to << BITS | delta + MIDDLE
        return step

    def count(self, pretoken: bytes) -> int:
        """Number of tokens of a pretoken: the sum along its path."""
        if len(self.steps) > MOST:
            self._reset()
        state = total = 0
        steps = self.steps
        for byte in pretoken:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step >> BITS
            total += step & (2 * MIDDLE - 1)
        return total - MIDDLE * len(pretoken)
