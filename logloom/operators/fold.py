"""Order-dependent clustering of token lists in plain Python; one instance holds one key's clusters."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

import regex

from logloom.config import PARAM

CREATED, CHANGED, NONE = "cluster_created", "cluster_template_changed", "none"


@dataclass(slots=True)
class Cluster:
    id: int
    tokens: list[str]
    size: int = 1
    template: str = ""

    def __post_init__(self) -> None:
        self.template = " ".join(self.tokens)

    def become(self, tokens: list[str]) -> str:
        """Take a merged template; what changed."""
        if tokens == self.tokens:
            return NONE
        self.tokens, self.template = tokens, " ".join(tokens)
        return CHANGED


def tokens_of(text: str) -> list[str]:
    """Tokens never hold white space, so a blank joins and splits them."""
    return text.split(" ") if text else []


@dataclass(slots=True)
class Node:
    children: dict[str, "Node"] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    #: Rises when a cluster of this leaf is new or changes.
    version: int = 0


def digits_in(token: str) -> bool:
    return any("0" <= c <= "9" for c in token)


def similarity(template: list[str], tokens: list[str], include_params: bool, param: str = PARAM) -> tuple[float, int]:
    """Share of positions that agree (wildcards only with ``include_params``) and number of wildcards."""
    if not template:
        return 1.0, 0
    params = template.count(param)
    hits = sum(map(str.__eq__, template, tokens))
    if params:
        # a literal wildcard in the line doesn't count as agreement
        hits -= sum(1 for t, x in zip(template, tokens) if t == param and x == param)
    return ((hits + params) if include_params else hits) / len(template), params


def merged(template: list[str], tokens: list[str], param: str = PARAM) -> list[str]:
    if len(template) != len(tokens):
        raise ValueError("token sequences differ in length")
    return [t if t == x else param for t, x in zip(template, tokens)]


class Drain:
    """Prefix-tree clustering: routes by token count and first tokens, joins the most similar cluster of
    the leaf at ``sim_th`` or more, else founds one. ``max_clusters`` keeps the most recently used."""

    def __init__(self, depth: int = 4, sim_th: float = 0.4, max_children: int = 100, max_clusters: int | None = None, param: str = PARAM, parametrize_numeric: bool = True):
        if depth < 3:
            raise ValueError("depth must be 3 or more")
        self.levels, self.sim_th, self.max_children = depth - 2, sim_th, max_children
        self.max_clusters, self.param, self.parametrize_numeric = max_clusters, param, parametrize_numeric
        self.roots: dict[int, Node] = {}
        self.clusters: OrderedDict[int, Cluster] = OrderedDict()
        self.last_id = 0
        #: Nodes ever made: while it stands still, every line's way through the tree does.
        self.made = 0
        self.seen: dict[str, tuple[Cluster, Node, int, int]] = {}

    def _route(self, tokens: list[str]) -> list[str]:
        """First tokens that choose the way; the last token never does."""
        return tokens[: max(min(self.levels, len(tokens)) - 1, 0)]

    def _leaf(self, tokens: list[str]) -> Node | None:
        node = self.roots.get(len(tokens))
        for token in self._route(tokens):
            if node is None:
                return None
            node = node.children.get(token) or node.children.get(self.param)
        return node

    def _best(self, ids: list[int], tokens: list[str], least: float, include_params: bool) -> Cluster | None:
        best, best_key = None, (-1.0, -1)
        for i in ids:
            cluster = self.clusters.get(i)
            if cluster is None:
                continue
            key = similarity(cluster.tokens, tokens, include_params, self.param)
            if key > best_key:
                best, best_key = cluster, key
        return best if best is not None and best_key[0] >= least else None

    def _search(self, tokens: list[str], least: float, include_params: bool) -> tuple[Node | None, Cluster | None]:
        leaf = self._leaf(tokens)
        if leaf is None:
            return None, None
        if not tokens:
            return leaf, next((self.clusters[i] for i in leaf.clusters if i in self.clusters), None)
        return leaf, self._best(leaf.clusters, tokens, least, include_params)

    def _place(self, tokens: list[str]) -> Node:
        """Leaf for a new cluster; adds nodes while ``max_children`` allows, else goes to the wildcard's."""
        node = self.roots.get(len(tokens))
        if node is None:
            node = self.roots[len(tokens)] = Node()
            self.made += 1
        for token in self._route(tokens):
            nxt = node.children.get(token)
            if nxt is None:
                wild, count = node.children.get(self.param), len(node.children)
                if self.parametrize_numeric and digits_in(token):
                    key = self.param
                elif wild is not None:
                    key = token if count < self.max_children else self.param
                else:
                    key = token if count + 1 < self.max_children else self.param
                nxt = node.children.get(key)
                if nxt is None:
                    nxt = node.children[key] = Node()
                    self.made += 1
            node = nxt
        return node

    def _ingest(self, tokens: list[str]) -> tuple[Cluster, str, Node]:
        leaf, cluster = self._search(tokens, self.sim_th, False)
        if cluster is not None:
            update = cluster.become(merged(cluster.tokens, tokens, self.param))
            cluster.size += 1
            if self.max_clusters is not None:
                self.clusters.move_to_end(cluster.id)
        else:
            self.last_id += 1
            cluster, update = Cluster(self.last_id, list(tokens)), CREATED
            self.clusters[cluster.id] = cluster
            if self.max_clusters is not None and len(self.clusters) > self.max_clusters:
                self.clusters.popitem(last=False)
            leaf = self._place(tokens)
            leaf.clusters = [i for i in leaf.clusters if i in self.clusters]
            leaf.clusters.append(cluster.id)
        leaf.version += update != NONE
        return cluster, update, leaf

    def add(self, tokens: list[str]) -> tuple[Cluster, str]:
        """Ingest one line: its cluster after the update, and what changed."""
        return self._ingest(tokens)[:2]

    def add_joined(self, text: str) -> tuple[Cluster, str]:
        """The same for tokens joined by blanks. A line that changed nothing and comes again while
        nothing on its way has changed joins the same cluster."""
        known = self.seen.get(text)
        if known is not None and known[1].version == known[2] and known[3] == self.made:
            known[0].size += 1
            return known[0], NONE
        cluster, update, leaf = self._ingest(tokens_of(text))
        if update == NONE and self.max_clusters is None:
            if len(self.seen) >= 100_000:
                self.seen.clear()
            self.seen[text] = (cluster, leaf, leaf.version, self.made)
        return cluster, update

    def match(self, tokens: list[str], strategy: str = "never") -> Cluster | None:
        """Read only, wildcards agree with anything, all positions must agree. Strategy: ``never`` looks in
        the tree, ``always`` at every cluster of the length, ``fallback`` in the tree and then at all."""
        if strategy not in ("never", "fallback", "always"):
            raise ValueError(f"unknown strategy: {strategy}")
        if strategy != "always":
            found = self._search(tokens, 1.0, True)[1]
            if found is not None or strategy == "never":
                return found
        same = sorted(i for i, c in self.clusters.items() if len(c.tokens) == len(tokens))
        return self._best(same, tokens, 1.0, True)

    def total_size(self) -> int:
        return sum(c.size for c in self.clusters.values())


class Postings:
    """Which templates have a token at a position: templates that agree with a line in ``least`` of some
    positions agree in one of the ``len(positions) - least + 1`` with the fewest templates."""

    def __init__(self) -> None:
        self.at: dict[tuple[int, str], set[int]] = {}

    def put(self, i: int, tokens: list[str | None], skip: str | None = None) -> None:
        for p, t in enumerate(tokens):
            if t != skip:
                self.at.setdefault((p, t), set()).add(i)

    def drop(self, i: int, p: int, token: str) -> None:
        self.at[p, token].discard(i)

    def candidates(self, spots: list[tuple[int, str]], least: int) -> list[int]:
        lists = sorted((x for s in spots if (x := self.at.get(s))), key=len)
        # positions that no template has can't be among those that agree
        few = lists[: max(len(lists) - least + 1, 0)] if least > 0 else lists
        return sorted(set().union(*few))


def least_hits(n: int, share: float) -> int:
    """Smallest h with h / n >= share."""
    return next((h for h in range(n + 1) if h / n >= share), n + 1) if n else 0


class FullSearch:
    """Every cluster of the same length is a candidate: most similar, then most wildcards, then earliest."""

    def __init__(self, sim_th: float = 0.4, param: str = PARAM):
        self.sim_th, self.param = sim_th, param
        self.clusters: list[Cluster] = []
        self.postings: dict[int, Postings] = {}
        self.least: dict[int, int] = {}
        #: Lines and their clusters since the last change.
        self.seen: dict[str, Cluster] = {}

    def _candidates(self, tokens: list[str]) -> list[Cluster]:
        n = len(tokens)
        least = self.least.setdefault(n, least_hits(n, self.sim_th))
        if least <= 0:
            return [c for c in self.clusters if len(c.tokens) == n]
        spots = [(p, t) for p, t in enumerate(tokens) if t != self.param]
        found = self.postings.setdefault(n, Postings()).candidates(spots, least)
        return [self.clusters[i - 1] for i in found]

    def add_joined(self, text: str) -> tuple[Cluster, str]:
        known = self.seen.get(text)
        if known is not None:
            known.size += 1
            return known, NONE
        tokens = tokens_of(text)
        best, best_key = None, (-1.0, -1)
        for c in self._candidates(tokens):
            if (score := similarity(c.tokens, tokens, False, self.param)) > best_key:
                best, best_key = c, score
        postings = self.postings.setdefault(len(tokens), Postings())
        if best is None or best_key[0] < self.sim_th:
            best, update = Cluster(len(self.clusters) + 1, tokens), CREATED
            self.clusters.append(best)
            postings.put(best.id, tokens, self.param)
        else:
            before = best.tokens
            update = best.become(merged(best.tokens, tokens, self.param))
            for p, (t, x) in enumerate(zip(before, best.tokens)):
                if t != x:
                    postings.drop(best.id, p, t)
            best.size += 1
        if update == NONE:
            self.seen[text] = best
        else:
            self.seen.clear()
        return best, update


_LETTER = regex.compile(r"[\p{Alphabetic}\p{N}]")


def letters_in(token: str) -> int:
    """Characters that are letters or numbers."""
    return len(token) if token.isascii() and token.isalnum() else len(_LETTER.findall(token))


class Statistical:
    """Groups of token lists of one length by shared anchors, weighted by how rare they are in the window.
    ``weights`` holds the anchors. Lines without an anchor stay alone, and as no line can join them nothing
    is kept of them."""

    def __init__(self, sim_th: float = 0.65, shared: int = 2, remaining: int = 2, static_chars: int = 3):
        self.sim_th, self.shared, self.remaining, self.static_chars = sim_th, shared, remaining, static_chars
        self.templates: dict[int, list[str | None]] = {}
        self.postings, self.last = Postings(), -1
        #: Lines and their clusters since the last change.
        self.seen: dict[str, int] = {}

    def add_joined(self, text: str, weights: dict[str, float]) -> int:
        """The same for tokens joined by blanks."""
        known = self.seen.get(text)
        return known if known is not None else self.add(tokens_of(text), weights, text)

    def add(self, tokens: list[str], weights: dict[str, float], text: str | None = None) -> int:
        """Number of the line's cluster."""
        spots = [(p, t) for p, t in enumerate(tokens) if t in weights]
        anchors = len(spots)
        if not anchors:
            self.last += 1
            return self.last
        needed = min(self.remaining, anchors)
        best, best_key = None, None
        least = max(needed, min(self.shared, needed), least_hits(anchors, self.sim_th))
        for i in self.postings.candidates(spots, least):
            template = self.templates[i]
            same = [p for p, t in spots if template[p] == t]
            # the anchors that stay static after merging are the ones that agree
            if len(same) < least or sum(letters_in(tokens[p]) for p in same) < self.static_chars:
                continue
            weight = 0.0
            for p in same:
                weight += weights[tokens[p]]
            key = (weight, len(same) / anchors, len(same))
            if best_key is None or key > best_key:
                best, best_key = i, key
        changed = best is None
        if best is None:
            self.last += 1
            best = self.last
            self.templates[best] = list(tokens)
            self.postings.put(best, tokens)
        else:
            template = self.templates[best]
            for p, t in enumerate(template):
                if t is not None and t != tokens[p]:
                    self.postings.drop(best, p, t)
                    template[p], changed = None, True
        if changed:
            self.seen.clear()
        elif text is not None:
            self.seen[text] = best
        return best


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Longest common subsequence as runs (equal or gap, i1, i2, j1, j2); ties skip in ``a`` first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out: list[list] = []
    i = j = 0

    def put(tag: str, i2: int, j2: int) -> None:
        if out and out[-1][0] == tag:
            out[-1][2], out[-1][4] = i2, j2
        else:
            out.append([tag, i, i2, j, j2])

    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            put("equal", i + 1, j + 1)
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            put("gap", i + 1, j)
            i += 1
        else:
            put("gap", i, j + 1)
            j += 1
    return [tuple(x) for x in out]


def pair_template(a: list[str], b: list[str], param: str = PARAM) -> str:
    """Template of two token lists: common runs and wildcards, no two wildcards in a row."""
    out: list[str] = []
    for tag, i1, i2, _, _ in opcodes(a, b):
        for token in a[i1:i2] if tag == "equal" else [param]:
            if token != param or not out or out[-1] != param:
                out.append(token)
    return " ".join(out)
