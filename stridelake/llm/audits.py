"""The cheapest edits of a sequence of turns, with their record shared between the ways to write it.

A dynamic programme goes over the turns with one best record for each state of the conversation. Records are never
copied: each is a node that adds one letter to the node before it (a persistent list), with the rolling hash of the
whole record and links to its ancestors 1, 2, 4, ... letters back. Of two records at the same cost the one that is
least in ASCII order stays; the first letter in which they differ is found by a binary search over the ancestors'
hashes, and what the hashes call equal is read letter by letter before it is believed.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash

MODULUS = (1 << 61) - 1
BASE = 911_382_323

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

#: States by what was written last: nothing, system, user, assistant; and where an initial leads from there.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one initial that a changed or inserted turn can have in each state.
NEEDED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: In a plan: the turn's new role where it changes, by the initial that is needed.
CHANGED = {"u": "U", "a": "A"}

#: Faults of a turn, in the order in which the first one counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


class Records:
    """All records of one run. Node 0 is the empty one.

    A letter may be a whole word, when no two words that can stand in one place begin one another.
    """

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letters: list[str] = [""]
        self.hashes: list[int] = [0]
        self.lengths: list[int] = [0]
        self.ancestors: list[list[int]] = [[]]

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letters)
        self.letters.append(letter)
        self.hashes.append((self.hashes[parent] * BASE + _number(letter)) % self.modulus)
        self.lengths.append(self.lengths[parent] + 1)
        links, at, k = [parent], parent, 0
        while k < len(self.ancestors[at]):
            at = self.ancestors[at][k]
            links.append(at)
            k += 1
        self.ancestors.append(links)
        return node

    def lifted(self, node: int, length: int) -> int:
        """The node's ancestor whose record has `length` letters."""
        back = self.lengths[node] - length
        while back:
            k = back.bit_length() - 1
            node = self.ancestors[node][k]
            back -= 1 << k
        return node

    def path(self, node: int) -> list[int]:
        """The nodes from the first letter to this one."""
        nodes = []
        while node:
            nodes.append(node)
            node = self.ancestors[node][0]
        return nodes[::-1]

    def text(self, node: int) -> str:
        return "".join(self.letters[n] for n in self.path(node))

    def less(self, one: int, other: int) -> bool:
        """Whether the record of `one` comes before that of `other`."""
        length = min(self.lengths[one], self.lengths[other])
        a, b = self.lifted(one, length), self.lifted(other, length)
        if self.hashes[a] != self.hashes[b]:
            return self._differ(a, b)
        found = self._first_difference(a, b)
        return self.lengths[one] < self.lengths[other] if found is None else found

    def _differ(self, a: int, b: int) -> bool:
        """Binary search for the first letter in which two records of one length and unlike hashes differ."""
        top_a, top_b = a, b
        for k in range(len(self.ancestors[a]) - 1, -1, -1):
            if k < len(self.ancestors[a]):
                up_a, up_b = self.ancestors[a][k], self.ancestors[b][k]
                if self.hashes[up_a] != self.hashes[up_b]:
                    a, b = up_a, up_b
        # The parents' hashes agree; where they do so by accident the first difference lies before this one.
        before = self._first_difference(self.ancestors[a][0], self.ancestors[b][0])
        if before is not None:
            return before
        if self.letters[a] == self.letters[b]:
            return bool(self._first_difference(top_a, top_b))
        return self.letters[a] < self.letters[b]

    def _first_difference(self, a: int, b: int) -> bool | None:
        """Read two records of one length back to where they share nodes: which one is less, None if none is."""
        found = None
        while a != b:
            if self.letters[a] != self.letters[b]:
                found = self.letters[a] < self.letters[b]
            a, b = self.ancestors[a][0], self.ancestors[b][0]
        return found


def _number(letter: str) -> int:
    return ord(letter) if len(letter) == 1 else xxhash.xxh3_64_intdigest(letter)


Way = tuple[int, int]


def advance(records: Records, ways: dict[int, Way], turns: Iterable[tuple[str, int]]) -> dict[int, Way]:
    """The best way (cost, record) to each state after the turns (initial, fault), without inserted turns at the end.

    So every record ends with the letter of the last turn, and no two of them begin one another.
    """
    for initial, fault in turns:
        after: dict[int, tuple[int, int, str]] = {}
        for state, (cost, record) in with_inserts(records, ways).items():
            _offer(records, after, state, cost + DELETE_COST, record, DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            cost += TRUNCATED_COST if fault == TRUNCATED else 0
            kept = STEP.get((state, initial))
            if kept is not None:
                _offer(records, after, kept, cost, record, KEEP)
            _offer(records, after, STEP[state, NEEDED[state]], cost + REROLE_COST, record, REROLE)
        ways = {state: (cost, records.add(record, letter)) for state, (cost, record, letter) in after.items()}
    return ways


def _offer(records: Records, after: dict, state: int, cost: int, record: int, letter: str) -> None:
    best = after.get(state)
    if best is not None:
        if best[0] < cost:
            return
        if best[0] == cost:
            one, other = records.add(record, letter), records.add(best[1], best[2])
            if not records.less(one, other):
                return
    after[state] = (cost, record, letter)


def with_inserts(records: Records, ways: dict[int, Way]) -> dict[int, Way]:
    """Add inserted turns until no state gets cheaper or its record less; each costs something, so it ends."""
    ways = dict(ways)
    todo = list(ways)
    while todo:
        state = todo.pop(0)
        cost, record = ways[state]
        target, cost = STEP[state, NEEDED[state]], cost + INSERT_COST
        best = ways.get(target)
        if best is not None and best[0] < cost:
            continue
        record = records.add(record, INSERT)
        if best is None or cost < best[0] or records.less(record, best[1]):
            ways[target] = (cost, record)
            todo.append(target)
    return ways


def cheapest(records: Records, ways: dict[int, Way]) -> Way:
    """The best way to an end that a conversation may have, inserted turns included."""
    best = None
    for state, way in with_inserts(records, ways).items():
        if state in FINAL and (
            best is None or way[0] < best[0] or (way[0] == best[0] and records.less(way[1], best[1]))
        ):
            best = way
    return best


def plan_of(entry: int, turns: list[tuple[str, int]], record: str) -> tuple[list[str], str]:
    """What a record does, one text for each turn, and the initials of the turns inserted at the end.

    A text has the initials of the turns inserted before the turn, then K or D, or U or A for its new role.
    """
    plan, state, inserted, at = [], entry, "", 0
    for letter in record:
        if letter == INSERT:
            inserted += NEEDED[state]
            state = STEP[state, NEEDED[state]]
            continue
        if letter == REROLE:
            plan.append(inserted + CHANGED[NEEDED[state]])
            state = STEP[state, NEEDED[state]]
        else:
            plan.append(inserted + letter)
            state = STEP[state, turns[at][0]] if letter == KEEP else state
        inserted, at = "", at + 1
    return plan, inserted


def segment(turns: list[tuple[str, int]], entries: Iterable[int]) -> list[tuple[int, int, int, str, list[str]]]:
    """(entry, exit, cost, record, plan) of the best way from each entry state to each state."""
    out = []
    for entry in entries:
        records = Records()
        for state, (cost, record) in advance(records, {entry: (0, 0)}, turns).items():
            text = records.text(record)
            out.append((entry, state, cost, text, plan_of(entry, turns, text)[0]))
    return out
