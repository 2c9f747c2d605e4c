"""The path-template tree in plain Python: nodes as dictionaries, one host after the other."""

import hashlib
import json
import math
from collections import defaultdict


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def rule_for(host, path, rules):
    fit = [(len(h + p), len(h), said == "block", said, h + p) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[4], max(fit)[3]) if fit else (None, None)


def add(a, b):
    return [x + y for x, y in zip(a, b, strict=True)]


def grow(paths, many, each, wide, labels=()):
    """paths: {segments: counts} below one node; yields (whole path, labels)."""
    level = len(labels)
    kids = defaultdict(dict)
    for segs, n in paths.items():
        if len(segs) == level:
            yield segs, (*labels, "")
        else:
            kids[segs[level]][segs] = n
    pages = {s: sum(n[0] for n in own.values()) for s, own in kids.items()}
    bar = max(each, sum(pages.values()) / wide)
    rare = {s for s, n in pages.items() if n < bar}
    rare = rare if len(rare) >= many else set()
    together = {}
    for s, own in kids.items():
        if s in rare:
            together.update(own)
        elif len(own) == 1:
            segs = next(iter(own))
            yield segs, (*labels, "/".join(segs[level:]), "")
        else:
            yield from grow(own, many, each, wide, (*labels, s))
    if together:
        yield from grow(together, many, each, wide, (*labels, "*"))


def merge(node, z, main):
    """node: {label: node or counts}. The node with similar branches merged from the leaves up, and what maps a path's labels to those there."""
    if isinstance(node, list):
        return node, lambda way: way
    below = {label: merge(child, z, main) for label, child in node.items()}
    node, names = {label: child for label, (child, _) in below.items()}, {}
    groups = defaultdict(list)
    for label, child in node.items():
        if isinstance(child, dict):
            chief = sorted(k for k, c in child.items() if total(c)[0] >= main * total(child)[0])
            groups[json.dumps({"c": chief, "d": label.count("/")}, separators=(",", ":"), ensure_ascii=False)].append(label)
    for form, own in groups.items():
        pool = defaultdict(int)
        for label in own:
            for k, c in node[label].items():
                pool[k] += total(c)[0]
        pb, pa = (sum(total(node[x])[i] for x in own) for i in (1, 2))
        rate, free, alike = (pb + 1) / (pb + pa + 2), len(pool) - 1, []
        for label in own if len(own) > 1 else ():
            n, b, a = total(node[label])
            x2 = sum(total(c)[0] ** 2 * sum(pool.values()) / (n * pool[k]) for k, c in node[label].items()) - n
            near = b + a == 0 or abs(b / (b + a) - rate) <= z * math.sqrt(rate * (1 - rate) / (b + a))
            if near and x2 <= free + z * math.sqrt(2 * free) + 1e-9:
                alike.append(label)
        if len(alike) > 1:
            leaf = list(node[alike[0]]) == [""]
            names |= dict.fromkeys(alike, "*" if leaf else "*" + hashlib.sha256(form.encode()).hexdigest()[:8])
    together = defaultdict(list)
    for label, child in node.items():
        together[names.get(label, label)].append(child)
    return {label: united(own) for label, own in together.items()}, lambda way: (names.get(way[0], way[0]), *below[way[0]][1](way[1:])) if way else ()


def united(nodes):
    if isinstance(nodes[0], list):
        return [sum(x) for x in zip(*nodes, strict=True)]
    return {k: united([n[k] for n in nodes if k in n]) for k in {k for n in nodes for k in n}}


def total(node):
    return node if isinstance(node, list) else [sum(x) for x in zip(*map(total, node.values()), strict=True)]
