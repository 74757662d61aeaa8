"""Graph kernels on adjacency maps {node: {neighbour: weight}}. Ties are broken by node."""

from __future__ import annotations

import heapq
import math


def adjacency(edges, directed=False) -> dict:
    """From (src, dst, weight[, is_directed]) rows; the least of parallel weights."""
    out: dict = {}
    for e in edges:
        a, b, w = e[:3]
        one_way = e[3] if len(e) > 3 else directed
        for p, q in ((a, b),) if one_way else ((a, b), (b, a)):
            row = out.setdefault(p, {})
            row[q] = min(w, row.get(q, math.inf))
            out.setdefault(q, {})
    return out


def reversed_graph(g) -> dict:
    out: dict = {v: {} for v in g}
    for a, row in g.items():
        for b, w in row.items():
            out[b][a] = w
    return out


def walk_back(previous, target) -> list:
    path = [target]
    while previous[path[-1]] is not None:
        path.append(previous[path[-1]])
    return path[::-1]


def search(g, source, target=None, blocked=(), edge_filter=None, cost=None, estimate=None) -> tuple[dict, dict]:
    """(distance, previous) of what was settled; with an estimate to the target this is A*."""
    if source not in g or source in blocked:
        return {}, {}
    best, previous, done = {source: 0.0}, {source: None}, set()
    heap = [(estimate(source) if estimate else 0.0, source)]
    while heap:
        _, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v == target:
            break
        for u in sorted(g[v]):
            if u in done or u in blocked or (edge_filter and not edge_filter(v, u)):
                continue
            w = cost(v, u, g[v][u]) if cost else g[v][u]
            if not math.isfinite(w):
                continue
            d = best[v] + w
            if d < best.get(u, math.inf):
                best[u], previous[u] = d, v
                heapq.heappush(heap, (d + (estimate(u) if estimate else 0.0), u))
    return {v: best[v] for v in done}, previous


def shortest_path(g, source, target, **options) -> list:
    best, previous = search(g, source, target, **options)
    return walk_back(previous, target) if target in best else []


def bidirectional_path(g, source, target) -> list:
    """Two searches that take turns until their radii add up to the best meeting."""
    if source not in g or target not in g:
        return []
    sides = [(g, {source: 0.0}, {source: None}, set(), [(0.0, source)]), (reversed_graph(g), {target: 0.0}, {target: None}, set(), [(0.0, target)])]
    most, at = (0.0, source) if source == target else (math.inf, None)
    while sides[0][4] and sides[1][4] and sides[0][4][0][0] + sides[1][4][0][0] < most:
        k = 0 if sides[0][4][0][0] <= sides[1][4][0][0] else 1
        own, best, previous, done, heap = sides[k]
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for u, w in sorted(own[v].items()):
            if d + w < best.get(u, math.inf):
                best[u], previous[u] = d + w, v
                heapq.heappush(heap, (d + w, u))
            if u in sides[1 - k][1] and best[u] + sides[1 - k][1][u] < most:
                most, at = best[u] + sides[1 - k][1][u], u
    return walk_back(sides[0][2], at) + walk_back(sides[1][2], at)[::-1][1:] if at is not None else []


def length(g, path) -> float:
    return sum(g[a][b] for a, b in zip(path, path[1:]))


def k_shortest_paths(g, source, target, k) -> list:
    """Loopless paths in order of length, then of nodes."""
    first = shortest_path(g, source, target)
    if not first:
        return []
    found, queue, seen = [first], [], {tuple(first)}
    while len(found) < k:
        last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            barred = {(p[i], p[i + 1]) for p in found if len(p) > i + 1 and p[: i + 1] == root}
            spur = shortest_path(g, root[-1], target, blocked=set(root[:-1]), edge_filter=lambda a, b, barred=barred: (a, b) not in barred)
            if spur and tuple(root[:-1] + spur) not in seen:
                path = root[:-1] + spur
                seen.add(tuple(path))
                heapq.heappush(queue, (length(g, path), path))
        if not queue:
            break
        found.append(heapq.heappop(queue)[1])
    return found


def breadth_first(g, start) -> list:
    order, seen = [start], {start}
    for v in order:
        for u in sorted(g[v]):
            if u not in seen:
                seen.add(u)
                order.append(u)
    return order


def depth_first(g, start) -> list:
    order, seen, stack = [], set(), [start]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            order.append(v)
            stack.extend(u for u in sorted(g[v], reverse=True) if u not in seen)
    return order


def strongly_connected(g) -> list:
    """Components by finishing order and a search of the reversed graph; each sorted, in order of their least node."""
    order, seen = [], set()
    for root in sorted(g):
        stack = [(root, iter(sorted(g[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            v, rest = stack[-1]
            u = next((u for u in rest if u not in seen), None)
            if u is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(u)
                stack.append((u, iter(sorted(g[u]))))
    back, own, out = reversed_graph(g), set(), []
    for root in reversed(order):
        if root not in own:
            part, stack = [], [root]
            own.add(root)
            while stack:
                v = stack.pop()
                part.append(v)
                for u in back[v]:
                    if u not in own:
                        own.add(u)
                        stack.append(u)
            out.append(sorted(part))
    return sorted(out)


def low_links(g) -> tuple[set, set]:
    """(bridges, articulation points) of the undirected graph beneath."""
    und: dict = {v: set() for v in g}
    for a, row in g.items():
        for b in row:
            if a != b:
                und[a].add(b)
                und[b].add(a)
    entered, low, bridges, joints = {}, {}, set(), set()
    for root in sorted(und):
        if root in entered:
            continue
        entered[root] = low[root] = len(entered)
        stack, branches = [(root, None, iter(sorted(und[root])))], 0
        while stack:
            v, parent, rest = stack[-1]
            u = next(rest, None)
            if u is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > entered[parent]:
                        bridges.add((min(v, parent), max(v, parent)))
                    if parent == root:
                        branches += 1
                    elif low[v] >= entered[parent]:
                        joints.add(parent)
            elif u == parent:
                continue
            elif u in entered:
                low[v] = min(low[v], entered[u])
            else:
                entered[u] = low[u] = len(entered)
                stack.append((u, v, iter(sorted(und[u]))))
        if branches > 1:
            joints.add(root)
    return bridges, joints


def betweenness_from(g, source, tie=1e-9) -> dict:
    """One source's dependencies: shares of its shortest paths through each node."""
    best, count, before, order, done = {source: 0.0}, {source: 1.0}, {source: []}, [], set()
    heap = [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done or d > best[v] + tie:
            continue
        done.add(v)
        order.append(v)
        for u, w in g[v].items():
            nd = best[v] + w
            if u not in best or nd < best[u] - tie:
                best[u], count[u], before[u] = nd, count[v], [v]
                heapq.heappush(heap, (nd, u))
            elif abs(nd - best[u]) <= tie and v not in before[u]:
                count[u] += count[v]
                before[u].append(v)
    share = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for p in before[v]:
            share[p] += count[p] / count[v] * (1 + share[v])
    share.pop(source, None)
    return share


def contracted(g, keep=()) -> tuple[dict, dict]:
    """(graph without chain nodes, {(a, b): the chain between}); the shorter of parallel chains stays.

    A chain node has two neighbours, both ways, that aren't adjacent to each other.
    """
    out = {v: dict(row) for v, row in g.items()}
    chain: dict = {}
    inner = lambda a, b: chain.get((a, b), [])
    for v in sorted(g):
        if v in keep or len(out[v]) != 2:
            continue
        a, b = sorted(out[v])
        if not (v in out[a] and v in out[b] and math.isclose(out[a][v], out[v][a]) and math.isclose(out[b][v], out[v][b])) or b in out[a]:
            continue
        w, middle = out[a][v] + out[v][b], [*inner(a, v), v, *inner(v, b)]
        for p, q, m in ((a, b, middle), (b, a, middle[::-1])):
            out[p].pop(v)
            out[p][q], chain[p, q] = w, m
        del out[v]
    return out, {k: m for k, m in chain.items() if k[0] in out and k[1] in out.get(k[0], {})}


def expanded(path, chain) -> list:
    out = path[:1]
    for a, b in zip(path, path[1:]):
        out += [*chain.get((a, b), []), b]
    return out


def path_via_contraction(g, source, target, finder=shortest_path) -> list:
    small, chain = contracted(g, keep={source, target})
    return expanded(finder(small, source, target), chain)


def cycles(g, start, most_nodes=8, longest=math.inf) -> list:
    """Simple cycles through start, each once whichever way it runs, shortest first."""
    out: dict = {}

    def extend(path, d):
        for u in sorted(g[path[-1]]):
            nd = d + g[path[-1]][u]
            if nd > longest:
                continue
            if u == start and len(path) > 2:
                body = path[1:]
                key = tuple(path) if body[0] < body[-1] else (start, *body[::-1])
                out.setdefault(key, nd)
            elif u not in path and len(path) < most_nodes:
                extend([*path, u], nd)

    extend([start], 0.0)
    return [[*c, start] for c, _ in sorted(out.items(), key=lambda i: (i[1], i[0]))]


def euler_walk(edges, start) -> list:
    """A walk over every (a, b) edge once, from a start of the right parity."""
    near: dict = {}
    for k, (a, b) in enumerate(edges):
        near.setdefault(a, []).append((b, k))
        near.setdefault(b, []).append((a, k))
    for row in near.values():
        row.sort(reverse=True)
    used, stack, out = set(), [start], []
    while stack:
        row = near.get(stack[-1], [])
        while row and row[-1][1] in used:
            row.pop()
        if row:
            u, k = row.pop()
            used.add(k)
            stack.append(u)
        else:
            out.append(stack.pop())
    return out[::-1] if len(out) == len(edges) + 1 else []


def eulerian_path(g) -> list:
    edges = sorted({(min(a, b), max(a, b)) for a in g for b in g[a]})
    odd = sorted(v for v in g if len(g[v]) % 2)
    if len(odd) not in (0, 2) or not edges:
        return []
    return euler_walk(edges, odd[0] if odd else edges[0][0])


def postman_tour(g) -> list:
    """A closed walk over every edge: odd nodes are paired greedily by distance and their paths walked twice."""
    edges = sorted({(min(a, b), max(a, b)) for a in g for b in g[a]})
    odd = sorted(v for v in g if len(g[v]) % 2)
    reach = {v: search(g, v) for v in odd}
    pairs = sorted((reach[a][0][b], a, b) for i, a in enumerate(odd) for b in odd[i + 1 :] if b in reach[a][0])
    left = set(odd)
    for _, a, b in pairs:
        if a in left and b in left:
            left -= {a, b}
            path = walk_back(reach[a][1], b)
            edges += [(min(p, q), max(p, q)) for p, q in zip(path, path[1:])]
    return euler_walk(edges, edges[0][0]) if edges and not left else []


def salesperson_tour(g, nodes, start=None) -> list:
    """Closed tour: nearest neighbour from the start, then reversals while they shorten it."""
    nodes = sorted(set(nodes))
    d = {a: search(g, a)[0] for a in nodes}
    if any(b not in d[a] for a in nodes for b in nodes):
        return []
    tour, left = [start if start is not None else nodes[0]], set(nodes)
    left.discard(tour[0])
    while left:
        tour.append(min(left, key=lambda v: (d[tour[-1]][v], v)))
        left.discard(tour[-1])
    better = len(tour) > 3
    while better:
        better = False
        for i in range(1, len(tour) - 1):
            for j in range(i + 1, len(tour)):
                a, b, c, e = tour[i - 1], tour[i], tour[j], tour[(j + 1) % len(tour)]
                if d[a][c] + d[b][e] < d[a][b] + d[c][e] - 1e-7:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True
    return [*tour, tour[0]]
