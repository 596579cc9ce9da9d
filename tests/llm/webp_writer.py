"""Writes lossless WebP files that use every feature, for tests of the decoder."""

import struct

import numpy as np

from sievelight.llm.webp import ORDER, Writer, near, predicted


def lengths_of(counts, limit=15):
    """Huffman code lengths; counts are flattened until none is too long."""
    import heapq

    counts = list(counts)
    while True:
        used = [(c, i, (i,)) for i, c in enumerate(counts) if c]
        out = [0] * len(counts)
        if len(used) <= 1:
            for _, i, _ in used:
                out[i] = 1
            return out
        heapq.heapify(used)
        while len(used) > 1:
            a, b = heapq.heappop(used), heapq.heappop(used)
            for i in a[2] + b[2]:
                out[i] += 1
            heapq.heappush(used, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= limit:
            return out
        counts = [(c + 1) // 2 + 1 if c else 0 for c in counts]


def codes_of(lengths):
    code, last, out = 0, 0, {}
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n) if len(used) > 1 else (0, 0)
        code += 1
    return out


def put_code(w, counts):
    """Write the code's lengths; give its codes."""
    used = [i for i, c in enumerate(counts) if c] or [0]
    if len(used) <= 2 and max(used) < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        lengths = [0] * len(counts)
        for s in used:
            lengths[s] = 1
        return codes_of(lengths)
    lengths = lengths_of(counts)
    runs, at = [], 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        value, left = lengths[at], n
        at += n
        if value:
            runs.append((value, 0, 0))
            left -= 1
        while left:
            if value and left >= 3:
                k = min(6, left)
                runs.append((16, k - 3, 2))
            elif not value and left >= 11:
                k = min(138, left)
                runs.append((18, k - 11, 7))
            elif not value and left >= 3:
                k = min(10, left)
                runs.append((17, k - 3, 3))
            else:
                k = 1
                runs.append((value, 0, 0))
            left -= k
    inner = [0] * 19
    for s, _, _ in runs:
        inner[s] += 1
    if sum(x > 0 for x in inner) == 1:
        inner[next(i for i in range(19) if not inner[i])] = 1
    inner = lengths_of(inner, 7)
    w.put(0, 1)
    w.put(15, 4)
    for s in ORDER:
        w.put(inner[s], 3)
    w.put(0, 1)
    codes = codes_of(inner)
    for s, extra, n in runs:
        w.put(*codes[s])
        w.put(extra, n)
    return codes_of(lengths)


def prefix_of(value):
    """Symbol, extra bits' value and count."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    extra = top - 1
    return 2 * top + second, v & ((1 << extra) - 1), extra


def put_image(w, argb, top, cache_bits=0, references=True, region_bits=0):
    height, width = argb.shape
    flat = [int(x) for x in argb.ravel()]
    kept, ops, at = {}, [], 0
    places = {}
    while at < len(flat):
        length = 0
        if references:
            before = places.get(tuple(flat[at : at + 3]))
            if before is not None:
                while at + length < len(flat) and length < 4000 and flat[before + length] == flat[at + length]:
                    length += 1
        if length >= 3:
            far = at - before
            code = next((i + 1 for i, (x, y) in enumerate(near()) if max(1, x + y * width) == far), far + 120)
            ops.append((at, "copy", length, code))
        else:
            length, p = 1, flat[at]
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            ops.append((at, "cache", slot, 0) if cache_bits and kept.get(slot) == p else (at, "literal", p, 0))
        for i in range(at, at + length):
            places[tuple(flat[i : i + 3])] = i
            if cache_bits:
                kept[(0x1E35A7BD * flat[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[i]
        at += length
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, across = 1, 0
    group_of = lambda i: 0
    if top:
        w.put(1 if region_bits else 0, 1)
        if region_bits:
            w.put(region_bits - 2, 3)
            across, down = (width + (1 << region_bits) - 1) >> region_bits, (height + (1 << region_bits) - 1) >> region_bits
            groups = 2
            put_image(w, np.array([[((x + y) % 2) << 8 for x in range(across)] for y in range(down)], np.uint32), False)
            group_of = lambda i: (((i % width) >> region_bits) + ((i // width) >> region_bits)) % 2
    counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for at, kind, a, b in ops:
        c = counts[group_of(at)]
        if kind == "literal":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                c[k][s] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + prefix_of(a)[0]] += 1
            c[4][prefix_of(b)[0]] += 1
    codes = [[put_code(w, x) for x in c] for c in counts]
    for at, kind, a, b in ops:
        c = codes[group_of(at)]
        if kind == "literal":
            for k, s in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                w.put(*c[k][s])
        elif kind == "cache":
            w.put(*c[0][280 + a])
        else:
            for k, value, base in ((0, a, 256), (4, b, 0)):
                s, extra, n = prefix_of(value)
                w.put(*c[k][base + s])
                w.put(extra, n)


def write(rgba, transforms=(), cache_bits=0, references=True, region_bits=0, modes=None):
    """rgba: (height, width, 4) bytes."""
    height, width, _ = rgba.shape
    c = rgba.astype(np.uint32)
    argb = c[..., 3] << 24 | c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2]
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind in transforms:
        w.put(1, 1)
        h, wd = argb.shape
        parts = lambda p: [int(p) >> 24, int(p) >> 16 & 255, int(p) >> 8 & 255, int(p) & 255]
        join = lambda p: p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
        if kind == "predictor":
            w.put(0, 2)
            w.put(0, 3)
            grid = np.array([[((x + 3 * y) % 14) << 8 for x in range((wd + 3) // 4)] for y in range((h + 3) // 4)], np.uint32)
            put_image(w, grid, False)
            out = argb.copy()
            for y in range(h):
                for x in range(wd):
                    if x and y:
                        right = argb[y - 1, x + 1] if x + 1 < wd else argb[y, 0]
                        guess = predicted(int(grid[y // 4, x // 4]) >> 8, *[parts(p) for p in (argb[y, x - 1], argb[y - 1, x], right, argb[y - 1, x - 1])])
                    else:
                        guess = parts(argb[y, x - 1]) if x else parts(argb[y - 1, 0]) if y else [255, 0, 0, 0]
                    out[y, x] = join([(a - b) & 255 for a, b in zip(parts(argb[y, x]), guess, strict=True)])
            argb = out
        elif kind == "cross":
            w.put(1, 2)
            w.put(0, 3)
            grid = np.array([[0xFF000000 | (x * 37 + 200 & 255) << 16 | (y * 91 + 130 & 255) << 8 | (x * y + 77 & 255) for x in range((wd + 3) // 4)] for y in range((h + 3) // 4)], np.uint32)
            put_image(w, grid, False)
            s8 = lambda v: (v & 255) - 256 * ((v & 255) > 127)
            out = argb.copy()
            for y in range(h):
                for x in range(wd):
                    a, r, g, b = parts(argb[y, x])
                    _, rb, gb, gr = parts(grid[y // 4, x // 4])
                    out[y, x] = join([a, (r - (s8(gr) * s8(g) >> 5)) & 255, g, (b - (s8(gb) * s8(g) >> 5) - (s8(rb) * s8(r) >> 5)) & 255])
            argb = out
        elif kind == "green":
            w.put(2, 2)
            argb = (argb & np.uint32(0xFF00FF00)) | (((argb >> 16) - (argb >> 8)) & 255) << 16 | ((argb - (argb >> 8)) & 255)
        else:
            w.put(3, 2)
            colours = np.unique(argb)
            w.put(len(colours) - 1, 8)
            previous, coded = [0] * 4, []
            for p in colours:
                coded.append(join([(a - b) & 255 for a, b in zip(parts(p), previous, strict=True)]))
                previous = parts(p)
            put_image(w, np.array([coded], np.uint32), False)
            index = np.searchsorted(colours, argb).astype(np.uint32)
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            each, n = 8 >> bits, 1 << bits
            index = np.pad(index, ((0, 0), (0, -wd % n))).reshape(h, -1, n)
            argb = sum((index[..., i] << np.uint32(each * i)) for i in range(n)).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    w.put(0, 1)
    put_image(w, argb, True, cache_bits, references, region_bits)
    body = w.value.to_bytes((w.size + 7) // 8, "little")
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded
