"""A lexicon as a trie, intersected with Levenshtein automata: one deterministic automaton, made while words are read."""

from __future__ import annotations

import unicodedata

#: Signs that stand for letters at no cost.
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "*": "aeiou"}
_EDGE = "\"'`.,;:!?()[]{}<>|/\\#$%&*+-=_~^@§°“”„‘’‚«»‹›…–—¡¿"
_STANDING = frozenset("$@!*|")
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in _STANDING)
_INNER = str.maketrans(dict.fromkeys("-/_.,;:|&+=~", " "))
#: States and transitions of the automaton, and words, that are kept at most.
MOST_STATES, MOST_WORDS = 100_000, 400_000


def edits(length: int, stem: bool) -> int:
    """Edits that a term of so many letters may have: none in short terms, as most short words lie one edit from another."""
    return 0 if length < (7 if stem else 5) else 1 if length < 9 else 2


class Lexicon:
    """Terms, each a whole word or a stem (the beginning of a word), and the words that are known to be none of them.

    A state of the automaton is the set of all (trie node, edits so far) that the letters read allow: a letter may
    be missing, added, wrong, or swapped with its neighbour. States and transitions are made when they are first
    needed, so reading a word takes a step a letter, whatever the number of terms.
    """

    def __init__(self, terms: list[tuple[str, bool]], known: frozenset[str] = frozenset()):
        self.terms, self.known = terms, known
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # (term, stem, edits allowed) at a node
        self.room = [0]  # edits that any term below a node allows
        for t, (text, stem) in enumerate(terms):
            at, k = 0, edits(len(text), stem)
            self.room[0] = max(self.room[0], k)
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.room.append(0)
                at = self.next[at][c]
                self.room[at] = max(self.room[at], k)
            self.ends[at].append((t, stem, k))
        self._forget()
        self.words: dict[bytes, tuple[int, bool, str] | None] = {}

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        # The best stem that a state has just completed, and the best word that it completes at a word's end.
        self.stems: list[tuple[int, int] | None] = []
        self.wholes: list[tuple[int, int] | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set[tuple[int, int, str]]) -> int:
        # A term's letters may be missing in the word.
        todo = list(found)
        while todo:
            node, e, wait = todo.pop()
            if not wait:
                for m in self.next[node].values():
                    if e < self.room[m] and (m, e + 1, "") not in found:
                        found.add((m, e + 1, ""))
                        todo.append((m, e + 1, ""))
        least: dict[tuple[int, str], int] = {}
        for node, e, wait in found:
            least[node, wait] = min(e, least.get((node, wait), e))
        key = frozenset((n, e, w) for (n, w), e in least.items())
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.stems.append(self._best(key, True))
            self.wholes.append(self._best(key, False))
        return got

    def _best(self, state: frozenset, stem: bool) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that ends here."""
        return min(((e, t) for node, e, wait in state if not wait for t, s, k in self.ends[node] if s == stem and e <= k), default=None)

    def _step(self, at: int, c: str) -> int:
        likes = LOOK_ALIKES.get(c, "")
        found: set[tuple[int, int, str]] = set()
        for node, e, wait in self.sets[at]:
            if wait:
                if wait == c:
                    found.add((node, e, ""))
                continue
            for d, m in self.next[node].items():
                if d == c or d in likes:
                    found.add((m, e, ""))
                if e < self.room[m]:
                    found.add((m, e + 1, ""))
                    # Two letters swapped: c comes before d.
                    swapped = self.next[m].get(c)
                    if swapped is not None and e < self.room[swapped]:
                        found.add((swapped, e + 1, d))
            if e < self.room[node]:
                found.add((node, e + 1, ""))
        return self._state(found)

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that the word is, or whose stem it begins with."""
        if len(self.sets) > MOST_STATES:
            self._forget()
        at, best, steps = self.start, None, self.steps
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = steps[at][c] = self._step(at, c)
            if to == self.dead:
                return best
            at = to
            found = self.stems[at]
            if found is not None and (best is None or found < best):
                best = found
        whole = self.wholes[at]
        return whole if best is None else best if whole is None else min(best, whole)

    def _read(self, word: str) -> tuple[int, bool, str] | None:
        got = self.nearest(word) if word and word not in self.known else None
        if got is None:
            return None
        text, stem = self.terms[got[1]]
        return got[1], got[0] > 0, word

    def find(self, raw: bytes) -> tuple[int, bool, str] | None:
        """(term, whether it is misspelled, the word) if the token, or a part of it between signs, is a term."""
        if raw in self.words:
            return self.words[raw]
        if len(self.words) >= MOST_WORDS:
            self.words.clear()
        word = raw.decode("utf-8", "replace")
        word = (word if word.isascii() else unicodedata.normalize("NFKC", word)).lower()
        core = word.strip(_EDGE)
        got = self._read(core)
        if (got is None or got[1]) and not word.isalnum():
            # Signs within a word separate words, or stand for its letters.
            parts = core.translate(_INNER).split()
            other = [self._read(p) for p in parts] if len(parts) > 1 else []
            if not _STANDING.isdisjoint(word):
                other.append(self._read(word.strip(_PLAIN_EDGE)))
            other = [p for p in other if p]
            got = next((p for p in other if not p[1]), got or next(iter(other), None))
        self.words[raw] = got
        return got

    def hits(self, words: list[bytes]) -> list[tuple[int, tuple[int, bool, str]]]:
        """(place, what find() says) of all words that are terms."""
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > MOST_WORDS:
            # Cleared before, not while these words are looked up.
            self.words.clear()
            new = set(words)
        for w in new if len(new) < MOST_WORDS else ():
            self.find(w)
        if len(new) >= MOST_WORDS:
            return [(i, h) for i, w in enumerate(words) if (h := self.find(w))]
        return [(i, h) for i, h in enumerate(map(self.words.get, words)) if h]
