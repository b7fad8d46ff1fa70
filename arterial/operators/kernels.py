"""Per-graph and per-tile kernels: traversal that sets of rows can't express. All are deterministic."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

INF = float("inf")
NEIGHBOURS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


class Sets:
    """Union-find; a set's name is its least member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def link(self, a, b) -> bool:
        """join() of items that may be new."""
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        return self.join(a, b)


def adjacency(edges, nodes=()) -> dict:
    """node: {neighbour: length}; of parallel edges the shorter stays."""
    out: dict = {n: {} for n in nodes}
    for a, b, w in edges:
        for p, q in ((a, b), (b, a)):
            row = out.setdefault(p, {})
            row[q] = min(w, row.get(q, INF))
    return out


def labels(nodes, edges) -> dict:
    sets = Sets(nodes)
    for a, b, *_ in edges:
        sets.join(a, b)
    return {n: sets.find(n) for n in sets.up}


def spanning(candidates, component: dict) -> list:
    """Kruskal's forest over components; candidates: (d, a, b)."""
    sets = Sets(set(component.values()))
    return [(d, a, b) for d, a, b in sorted(candidates) if sets.join(component[a], component[b])]


def distances(adj: dict, source) -> dict:
    if source not in adj:
        return {}
    done: dict = {}
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        for v, w in adj[u].items():
            if v not in done:
                heapq.heappush(heap, (d + w, v))
    return done


def path(adj: dict, source, target):
    """(length, nodes) of a shortest path; among equals the one through smaller nodes last settled first; (inf, None) if cut off."""
    if source not in adj or target not in adj:
        return INF, None
    done: dict = {}
    heap = [(0.0, source, None)]
    while heap:
        d, u, before = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = before
        if u == target:
            out = [u]
            while done[out[-1]] is not None:
                out.append(done[out[-1]])
            return d, out[::-1]
        for v, w in adj[u].items():
            if v not in done:
                heapq.heappush(heap, (d + w, v, u))
    return INF, None


def dependencies(adj: dict, source):
    """Brandes' dependencies of one source: (by node, by edge). Equal lengths count as equal paths."""
    sigma: dict = defaultdict(float)
    sigma[source] = 1.0
    best = {source: 0.0}
    before: dict = defaultdict(list)
    order, done, heap = [], set(), [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in adj[u].items():
            if v in done or v == u:
                continue
            alt = d + w
            if alt < best.get(v, INF):
                best[v], sigma[v], before[v] = alt, sigma[u], [u]
                heapq.heappush(heap, (alt, v))
            elif alt == best[v]:
                sigma[v] += sigma[u]
                before[v].append(u)
    delta: dict = defaultdict(float)
    edge: dict = defaultdict(float)
    for v in reversed(order):
        for u in before[v]:
            c = sigma[u] / sigma[v] * (1 + delta[v])
            edge[min(u, v), max(u, v)] += c
            delta[u] += c
    delta.pop(source, None)
    return delta, edge


def betweenness(adj: dict, sources=None) -> dict:
    n = len(adj)
    out = dict.fromkeys(adj, 0.0)
    chosen = sorted(adj) if sources is None else sources
    for s in chosen:
        for v, d in dependencies(adj, s)[0].items():
            out[v] += d
    scale = n / len(chosen) / ((n - 1) * (n - 2)) if n > 2 and len(chosen) else 0.0
    return {v: x * scale for v, x in out.items()}


def efficiency(adj: dict, universe: int | None = None, sources=None) -> float:
    m = len(adj)
    n = m if universe is None else universe
    chosen = sorted(adj) if sources is None else sources
    if n < 2 or not chosen:
        return 0.0
    total = sum(1 / d for s in chosen for d in distances(adj, s).values() if d > 0)
    return total * m / len(chosen) / (n * (n - 1))


def without(adj: dict, gone) -> dict:
    gone = set(gone)
    return {u: {v: w for v, w in row.items() if v not in gone} for u, row in adj.items() if u not in gone}


def bridges(adj: dict) -> list:
    """Edges whose loss splits a component, by low links without recursion."""
    at: dict = {}
    low: dict = {}
    out, clock = [], 0
    for root in sorted(adj):
        if root in at:
            continue
        at[root] = low[root] = clock
        clock += 1
        stack = [(root, None, iter(sorted(adj[root])))]
        while stack:
            u, parent, it = stack[-1]
            for v in it:
                if v == parent or v == u:
                    continue
                if v in at:
                    low[u] = min(low[u], at[v])
                else:
                    at[v] = low[v] = clock
                    clock += 1
                    stack.append((v, u, iter(sorted(adj[v]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > at[parent]:
                        out.append((min(u, parent), max(u, parent)))
    return sorted(out)


def attack(adj: dict, k: int, dynamic: bool) -> list:
    """k nodes by betweenness: ranked once, or each time anew on what is left; ties to the smaller node."""
    def ranked(a):
        return sorted(a, key=lambda v: (-bc[v], v))

    bc = betweenness(adj)
    if not dynamic:
        return ranked(adj)[:k]
    out, left = [], adj
    for _ in range(min(k, len(adj))):
        bc = betweenness(left)
        out.append(ranked(left)[0])
        left = without(left, out[-1:])
    return out


# ---------------------------------------------------------------------------------------------------------- rasters


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel centre lines by Zhang and Suen's two alternating passes (CACM 1984)."""
    img = np.pad(np.asarray(mask) > 0, 1)
    changed = True
    while changed:
        changed = False
        for odd in (0, 1):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            count = sum(x.astype(int) for x in p)
            turns = sum((~a & b).astype(int) for a, b in zip(p, p[1:] + p[:1], strict=True))
            n, e, s, w = p[0], p[2], p[4], p[6]
            sides = ~(n & e & s) & ~(e & s & w) if not odd else ~(n & e & w) & ~(n & s & w)
            gone = img[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & sides
            if gone.any():
                img[1:-1, 1:-1] &= ~gone
                changed = True
    return img[1:-1, 1:-1]


def trace(cells, resolution: float = 1.0):
    """(nodes, {(a, b): (length, pixels)}) of skeleton cells. Nodes are cells whose number of neighbours isn't two; an
    edge is a chain between nodes. A ring without nodes gets its first cell as node, with a loop. Of parallel chains the
    shorter stays."""
    cells = set(cells)
    near = {p: [(p[0] + r, p[1] + c) for r, c in NEIGHBOURS if (p[0] + r, p[1] + c) in cells] for p in sorted(cells)}
    nodes = [p for p in near if len(near[p]) != 2]
    is_node = set(nodes)
    edges: dict = {}
    used: set = set()
    seen: set = set(nodes)

    def keep(pixels):
        length = sum(resolution * (2**0.5 if a[0] != b[0] and a[1] != b[1] else 1.0) for a, b in zip(pixels, pixels[1:], strict=False))
        key = (min(pixels[0], pixels[-1]), max(pixels[0], pixels[-1]))
        if key not in edges or length < edges[key][0]:
            edges[key] = (length, pixels if key[0] == pixels[0] else pixels[::-1])

    def walk(start, first):
        pixels = [start, first]
        used.add((start, first))
        while pixels[-1] not in is_node:
            seen.add(pixels[-1])
            onward = [q for q in near[pixels[-1]] if q != pixels[-2]]
            if not onward:
                break
            pixels.append(onward[0])
        used.add((pixels[-1], pixels[-2]))
        keep(pixels)

    for p in nodes:
        for q in near[p]:
            if (p, q) not in used:
                walk(p, q)
    for p in near:
        if p not in seen:
            is_node.add(p)
            nodes.append(p)
            seen.add(p)
            walk(p, near[p][0])
    return sorted(nodes), edges


def merge_junctions(adj: dict, xy: dict, most: float):
    """Contract edges of at most `most` between nodes of degree three or more, least pair first; the kept node moves to the middle."""
    adj, xy = {u: dict(r) for u, r in adj.items()}, dict(xy)
    degree = lambda u: len(adj[u]) + (u in adj[u])
    while True:
        short = min(((u, v) for u in adj for v, w in adj[u].items() if u < v and w <= most and degree(u) >= 3 and degree(v) >= 3), default=None)
        if short is None:
            break
        u, v = short
        xy[u] = tuple((a + b) / 2 for a, b in zip(xy[u], xy[v], strict=True))
        for t, w in adj.pop(v).items():
            if t not in (u, v):
                adj[t].pop(v, None)
                adj[u].setdefault(t, w)
                adj[t].setdefault(u, w)
        adj[u].pop(v, None)
        del xy[v]
    for u in adj:
        adj[u].pop(u, None)
    return adj, xy


def dissolve(adj: dict, xy: dict):
    """Fuse the two edges of each node of degree two, least node first; a parallel edge keeps the shorter length."""
    adj, xy = {u: dict(r) for u, r in adj.items()}, dict(xy)
    heap = sorted(u for u in adj if len(adj[u]) == 2)
    heapq.heapify(heap)
    while heap:
        u = heapq.heappop(heap)
        if u not in adj or len(adj[u]) != 2 or u in adj[u]:
            continue
        (a, wa), (b, wb) = sorted(adj.pop(u).items())
        del xy[u]
        adj[a].pop(u), adj[b].pop(u)
        w = min(wa + wb, adj[a].get(b, INF))
        adj[a][b] = adj[b][a] = w
        for t in (a, b):
            if len(adj[t]) == 2:
                heapq.heappush(heap, t)
    return adj, xy


def mask_graph(mask: np.ndarray, transform=None, resolution: float = 1.0, simplify: bool = True, merge_px: float = 2.5):
    """(adjacency, {node: (x, y)}) of a mask; node = row * width + col. transform: affine (a, b, c, d, e, f), pixel centres."""
    skeleton = thin(mask)
    width = mask.shape[1]
    nodes, edges = trace([tuple(p) for p in np.argwhere(skeleton).tolist()], resolution)
    num = lambda p: p[0] * width + p[1]

    def world(p):
        if transform is None:
            return float(p[1]), float(p[0])
        a, b, c, d, e, f = transform
        return a * (p[1] + 0.5) + b * (p[0] + 0.5) + c, d * (p[1] + 0.5) + e * (p[0] + 0.5) + f

    xy = {num(p): world(p) for p in nodes}
    adj = adjacency([(num(a), num(b), w) for (a, b), (w, _) in edges.items()], xy)
    if simplify:
        adj, xy = merge_junctions(adj, xy, merge_px * resolution)
        adj, xy = dissolve(adj, xy)
    return adj, xy


def near_pairs(xy: dict, gap: float):
    """(d2, a, b), a < b, of places at most `gap` apart, by cells of that size and the half of their neighbours ahead."""
    grid = defaultdict(list)
    for u in sorted(xy):
        grid[int(np.floor(xy[u][0] / gap)), int(np.floor(xy[u][1] / gap))].append(u)
    for (i, j), here in grid.items():
        for k, u in enumerate(here):
            ahead = [*here[k + 1 :], *(v for o in ((0, 1), (1, -1), (1, 0), (1, 1)) for v in grid.get((i + o[0], j + o[1]), ()))]
            for v in ahead:
                d2 = (xy[u][0] - xy[v][0]) ** 2 + (xy[u][1] - xy[v][1]) ** 2
                if d2 <= gap * gap:
                    yield d2, min(u, v), max(u, v)


def heal(adj: dict, xy: dict, gap: float, endpoints_only: bool = True) -> list:
    """Bridges (length, a, b) between components, as heal() of the graph operators makes them."""
    component = labels(adj, [(u, v) for u in adj for v in adj[u]])
    degree = {u: len(adj[u]) + (u in adj[u]) for u in adj}
    found = [(d, a, b) for d, a, b in near_pairs(xy, gap) if component[a] != component[b] and (not endpoints_only or degree[a] == 1 or degree[b] == 1)]
    return [(d**0.5, a, b) for d, a, b in spanning(found, component)]


def with_edges(adj: dict, edges) -> dict:
    out = {u: dict(row) for u, row in adj.items()}
    for w, a, b in edges:
        out[a][b] = out[b][a] = min(w, out[a].get(b, INF))
    return out


def report(adj: dict, hit, before: list | None = None, after: list | None = None) -> dict:
    """What the loss of hit nodes does: efficiency on one universe, components and largest component of what is left."""
    hit = set(hit) & set(adj)
    left = without(adj, hit)
    e0, e1 = efficiency(adj, None, before), efficiency(left, len(adj), after)
    sizes = defaultdict(int)
    for root in labels(left, [(u, v) for u in left for v in left[u]]).values():
        sizes[root] += 1
    ri = e1 / e0 if e0 > 0 else 0.0
    return {"n_nodes": len(adj), "n_impacted": len(hit), "efficiency_before": e0, "efficiency_after": e1, "components_after": len(sizes),
            "lcc_after": max(sizes.values()) / len(left) if left else 0.0, "resilience_index": ri, "efficiency_drop": 1 - ri}


def soft_skeleton(img: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Differentiable skeleton: residues of openings, by cross-shaped minima and square maxima."""
    def near(x, shape, pick, fill):
        p = np.pad(x, 1, constant_values=fill)
        return pick.reduce([p[1 + r : p.shape[0] - 1 + r, 1 + c : p.shape[1] - 1 + c] for r, c in shape])

    cross, square = [(-1, 0), (0, 0), (1, 0), (0, -1), (0, 1)], [*NEIGHBOURS, (0, 0)]
    erode = lambda x: near(x, cross, np.minimum, np.inf)
    opened = lambda x: near(erode(x), square, np.maximum, -np.inf)
    out = np.maximum(img - opened(img), 0)
    for _ in range(rounds):
        img = erode(img)
        rest = np.maximum(img - opened(img), 0)
        out = out + np.maximum(rest - out * rest, 0)
    return out


def segment_cover(shape, transform, segments, buffer: float) -> np.ndarray:
    """Mask of the pixels whose square comes within `buffer` of a segment (x0, y0, x1, y1); north-up transform."""
    a, _, c, _, e, f = transform
    out = np.zeros(shape, np.uint8)
    cx, cy = c + a * (np.arange(shape[1]) + 0.5), f + e * (np.arange(shape[0]) + 0.5)
    hx, hy = abs(a) / 2, abs(e) / 2
    for x0, y0, x1, y1 in segments:
        reach_x, reach_y = buffer + hx, buffer + hy
        cols = np.flatnonzero((cx >= min(x0, x1) - reach_x) & (cx <= max(x0, x1) + reach_x))
        rows = np.flatnonzero((cy >= min(y0, y1) - reach_y) & (cy <= max(y0, y1) + reach_y))
        if not len(cols) or not len(rows):
            continue
        gx, gy = np.meshgrid(cx[cols], cy[rows])
        best = np.full(gx.shape, np.inf)
        dx, dy = x1 - x0, y1 - y0
        steps = max(1, int(np.ceil(np.hypot(dx, dy) / min(hx, hy))))
        t0 = np.clip(((gx - x0) * dx + (gy - y0) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        for shift in (-1 / steps, -0.5 / steps, 0, 0.5 / steps, 1 / steps):
            t = np.clip(t0 + shift, 0, 1)
            ox, oy = np.maximum(np.abs(gx - x0 - t * dx) - hx, 0), np.maximum(np.abs(gy - y0 - t * dy) - hy, 0)
            best = np.minimum(best, np.hypot(ox, oy))
        out[np.ix_(rows, cols)] |= best <= buffer
    return out
