"""Deep-shallow sorting of byte strings, with the longest common prefixes of neighbours.

Multikey quicksort partitions on eight bytes at a time down to a shallow depth. Groups that are
equal so far, which have long common prefixes, are ordered by a blind trie: it branches on single
bytes, is searched without comparing what lies between, and compares a string once, with the leaf
that the blind search ends in.
"""

from __future__ import annotations

SHALLOW = 64
_STEP = 8


def common(a: bytes, b: bytes, depth: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``depth``."""
    n = min(len(a), len(b))
    if n <= depth:
        return n
    differ = int.from_bytes(a[depth:n], "big") ^ int.from_bytes(b[depth:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.children, self.leaf = depth, {}, leaf


def _blind_trie(strings: list[bytes], own: list[int], depth: int) -> tuple[list[int], list[int]]:
    """The order of ``own``, whose strings agree up to ``depth``, and the prefixes between neighbours.

    A node holds the depth it branches at and a leaf below it; a child is a node or a list of equal
    strings. The end of a string is the branch -1.
    """
    char = lambda s, d: s[d] if d < len(s) else -1
    root: _Node | list[int] = [own[0]]
    for i in own[1:]:
        s, at = strings[i], root
        while isinstance(at, _Node):
            at = at.children.get(char(s, at.depth), [at.leaf])
        leaf = at[0]
        shared = common(s, strings[leaf], depth)
        parent, branch, at = None, 0, root
        while isinstance(at, _Node) and at.depth < shared:
            parent, branch, at = at, char(s, at.depth), at.children[char(s, at.depth)]
        if isinstance(at, _Node) and at.depth == shared:
            if (key := char(s, shared)) in at.children:
                at.children[key].append(i)  # only the end of a string: equal strings
            else:
                at.children[key] = [i]
        elif not isinstance(at, _Node) and shared == len(s) == len(strings[at[0]]):
            at.append(i)
        else:
            node = _Node(shared, at.leaf if isinstance(at, _Node) else at[0])
            node.children = {char(strings[node.leaf], shared): at, char(s, shared): [i]}
            if parent is None:
                root = node
            else:
                parent.children[branch] = node
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple] = [(root, None)]
    while stack:
        at, before = stack.pop()
        if isinstance(at, _Node):
            for k, key in reversed(list(enumerate(sorted(at.children)))):
                stack.append((at.children[key], at.depth if k else before))
        else:
            if order:
                lcp.append(before)
            order += at
            lcp += [len(strings[at[0]])] * (len(at) - 1)
    return order, lcp


def sorted_with_prefixes(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Indices of ``strings`` in sorted order, and the common prefix of each with the next."""
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        own, depth = stack.pop()
        if not own:
            continue
        if len(own) == 1:
            part, inner = own, []
        elif depth >= shallow:
            part, inner = _blind_trie(strings, own, depth)
        else:
            keys = {i: strings[i][depth : depth + _STEP] for i in own}
            pivot = keys[own[len(own) // 2]]
            less, same, more = ([i for i in own if keys[i] < pivot], [i for i in own if keys[i] == pivot], [i for i in own if keys[i] > pivot])
            # a key cut short is the end of a string: those equal to it are equal altogether
            stack += [(more, depth), (same, depth + _STEP if len(pivot) == _STEP else max(shallow, depth)), (less, depth)]
            continue
        if order:
            lcp.append(common(strings[order[-1]], strings[part[0]]))
        order += part
        lcp += inner
    return order, lcp
