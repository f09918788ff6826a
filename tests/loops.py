"""Plain bar-by-bar versions of the triggers and choices, written from the rules, for comparison."""

import math
from collections import defaultdict

GAP = 50.0


def near(x, gap):
    return round(x / gap) * gap


def cents(x):
    return round(x * 100) / 100


class Book:
    """One session: bars by scrip, futures, and the chain by minute."""

    def __init__(self):
        self.bars, self.fut, self.chain = defaultdict(list), {}, defaultdict(dict)

    def atm(self, t):
        row, f = self.chain[t], self.fut[t][2]
        pair = lambda k: (row.get((k, "CE")), row.get((k, "PE")))
        k = near(f, GAP)
        if None in pair(k):
            return None
        k = near(pair(k)[0] - pair(k)[1] + k, GAP)
        tried = [(abs(pair(x)[0] - pair(x)[1]), i, x) for i, x in enumerate((k, k + GAP, k - GAP)) if None not in pair(x)]
        return min(tried)[2] if tried else None

    def pick(self, start, end, om="0"):
        """(t, ce, pe, ce price, pe price)"""
        up = float(om[3:]) * GAP if om.startswith("ATM") else 0.0
        for t in sorted(self.fut):
            if start is not None and start <= t <= end and (k := self.atm(t)) is not None:
                ce, pe = self.chain[t].get((k + up, "CE")), self.chain[t].get((k - up, "PE"))
                if ce is not None and pe is not None:
                    return t, f"{int(k + up)}CE", f"{int(k - up)}PE", ce, pe
        return None

    def above(self, start, end, target):
        for t in sorted(self.fut):
            if start <= t <= end:
                side = {k: min(((c, s) for (s, o), c in self.chain[t].items() if o == k and c >= target), default=None) for k in ("CE", "PE")}
                if None not in side.values():
                    return t, f"{int(side['CE'][1])}CE", f"{int(side['PE'][1])}PE", side["CE"][0], side["PE"][0]
        return None

    def strangle(self, start, end, target):
        for t in sorted(self.fut):
            if start <= t <= end:
                a = self.above(t, t, target)
                if a is None:
                    continue
                ck, pk = float(a[1][:-2]), float(a[2][:-2])
                best = None
                for i, (x, y) in enumerate([(0, 0), (0, -GAP), (-GAP, 0), (0, GAP), (GAP, 0)]):
                    ce, pe = self.chain[t].get((ck + x, "CE")), self.chain[t].get((pk + y, "PE"))
                    if ce and pe and 2 * target <= ce + pe <= 3 * target and (best is None or abs(ce - pe) < best[0]):
                        best = abs(ce - pe), t, f"{int(ck + x)}CE", f"{int(pk + y)}PE", ce, pe
                if best:
                    return best[1:]
        return None

    def straddle(self, ce, pe):
        p = {b[0]: b for b in self.bars[pe]}
        out = []
        for t, h, low, c in self.bars[ce]:
            if t in p:
                s = (h + p[t][2], low + p[t][1], c + p[t][3])
                out.append((t, max(s), min(s), s[2]))
        return out

    def common(self, a, b):
        there = {x[0] for x in self.bars[b]}
        return [x for x in self.bars[a] if x[0] in there]

    def close(self, scrip, t):
        return next((b[3] for b in self.bars[scrip] if b[0] == t), None)

    def upto(self, scrip, t):
        return [b[3] for b in self.bars[scrip] if b[0] <= t][-1]


def cut(bars, start, end):
    return [b for b in bars or [] if start is not None and start <= b[0] <= end]


def stop(bars, start, end, side="SELL", sl=0.0, slp=None, intra=0.0, target=None, cc=False, entry=None, rate=0.0, combined=False):
    w, g = cut(bars, start, end), 1 if side == "SELL" else -1
    r = {"o": None, "t": None, "pnl": 0.0, "target": False, "level": None, "points": []}
    if len(w) < 2:
        return r
    o = w[0][3] if entry is None else entry
    level = slp if slp is not None else (100 + g * sl) / 100 * o if sl else None
    far = (100 + g * intra) / 100 * o if intra else None
    px = None
    for t, h, low, c in w[1:]:
        worst, best = (h, low) if g > 0 else (low, h)
        if far is not None and g * worst >= g * far:
            px, r["t"] = far, t
        elif level is not None and g * (c if cc or combined else worst) >= g * level:
            px, r["t"] = (c if cc or combined else level), t
        elif target is not None and g * (c if combined else best) <= g * target:
            px, r["t"], r["target"] = (c if combined else target), t, True
        r["points"].append((t, g * (o - c) - o * rate))
        if px is not None:
            break
    r.update(o=o, level=level, pnl=cents(g * (o - (w[-1][3] if px is None else px)) - o * rate))
    r["points"][-1] = (r["points"][-1][0], r["pnl"])
    return r


def decay(bars, start, end, side="SELL", pct=None, price=None, cc=False):
    w, g = cut(bars, start, end), 1 if side == "SELL" else -1
    if len(w) < 2:
        return None, None
    if pct == 0:
        return start, w[0][3]
    level = price if price is not None else (100 - g * pct) / 100 * w[0][3]
    for t, h, low, c in w[1:]:
        if g * (c if cc else low if g > 0 else h) <= g * level:
            return t, level
    return None, level


def ticks(x, tick, up):
    return x if tick is None else round((math.ceil if up else math.floor)(round(x / tick, 6)) * tick, 2)


def trail(bars, start, end, mode, side="SELL", sl=0.0, slp=None, gap=1.0, step=0.0, sl_step=0.0, cc=False, to_cost=False, entry=None, rate=0.0, tick=None):
    w, g = cut(bars, start, end), 1 if side == "SELL" else -1
    r = {"o": w[0][3] if w else None, "t": None, "pnl": 0.0, "level": None, "moved": False}
    if len(w) < 2 or (mode == "STEP" and (step <= 0 or sl_step <= 0 or sl_step > step)):
        return r
    o = w[0][3] if entry is None else entry
    first = level = ticks(slp if slp is not None else (100 + g * sl) / 100 * o, tick, g > 0)
    best, px = (ticks((100 - g * step) / 100 * o, tick, g < 0) if mode == "STEP" else o), None
    for t, h, low, c in w[1:]:
        bad, good = (c, c) if cc else (h, low) if g > 0 else (low, h)
        if g * bad >= g * level:
            px, r["t"] = (c if cc else level), t
            break
        if g * good <= g * best if mode == "STEP" else g * good < g * best:
            r["moved"] = True
            if mode == "STEP":
                level *= 1 - g * sl_step / 100
            else:
                best = good
                level = {"RATIO": first - g * abs(o - best) * gap, "POINT": best + first - o, "PCT": best * (1 + g * sl / 100)}[mode]
            if to_cost:
                level = max(level, o) if g > 0 else min(level, o)
            level = ticks(level, tick, g > 0)
            if mode in ("RATIO", "STEP") and g * level <= g * best:
                px, r["t"] = (c if cc else best), t
                break
            if mode == "STEP":
                best = ticks(best * (1 - g * step / 100), tick, g < 0)
    r.update(o=o, level=level, pnl=cents(g * (o - (w[-1][3] if px is None else px)) - o * rate))
    return r


def trail_combined(bars, start, end, mode, side, sl, intra, gap=1.0, step=0.0, sl_step=0.0, rate=0.0):
    w, g = cut(bars, start, end), 1 if side == "SELL" else -1
    if len(w) < 2:
        return None
    o = w[0][3]
    first = {"s": (100 + g * sl) / 100 * o, "i": (100 + g * intra) / 100 * o}
    pct, level = {"s": sl, "i": intra}, dict(first)
    best, out = ((100 - g * step) / 100 * o if mode == "STEP" else o), None
    for t, h, low, c in w[1:]:
        worst, finest = (h, low) if g > 0 else (low, h)
        if g * worst >= g * level["i"]:
            out = t, level["i"]
        elif g * c >= g * level["s"]:
            out = t, c
        elif (g * c <= g * best or g * finest <= g * best) if mode == "STEP" else g * c < g * best:
            if mode != "STEP":
                best = c
            for k in level:
                level[k] = level[k] * (1 - g * sl_step / 100) if mode == "STEP" else {"RATIO": first[k] - g * abs(o - best) * gap, "POINT": best + first[k] - o, "PCT": best * (1 + g * pct[k] / 100)}[mode]
            crossed = {k: g * level[k] <= g * best for k in level}
            if mode in ("RATIO", "STEP") and any(crossed.values()):
                out = t, best if mode == "STEP" else level["i"] if crossed["i"] else level["s"]
            elif mode == "STEP":
                best *= 1 - g * step / 100
        if out:
            break
    return (out[0] if out else None), cents(g * (o - (out[1] if out else w[-1][3])) - o * rate)


def earlier(a, b):
    return "ce" if a is not None and (b is None or a < b) else "pe" if b is not None and (a is None or b < a) else None
