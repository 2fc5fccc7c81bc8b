"""Daily formulas as text: id -> expression over O, H, L, C, V, VWAP, RET and IDX (index close).

Windows count sessions of the dense calendar, so a gap is a null and never shortens a window. Where published
variants differ, the choice is: argmax and argmin take the earliest extreme; a recursive average carries its state over
nulls; null predicates take the other branch; covariance of a constant is 0; no null is filled in correlations.
Names that follow := are intermediate results, ended by semicolons.
"""

from __future__ import annotations

# Published definitions.
WQ = """
001: rank(argmax(iif(RET < 0, std(RET, 20), C) ** 2, 5)) - 0.5
002: -corr(rank(delta(log(V), 2)), rank((C - O) / O), 6)
003: -corr(rank(O), rank(V), 10)
004: -tsrank(rank(L), 9)
005: rank(O - sum(VWAP, 10) / 10) * -abs(rank(C - VWAP))
006: -corr(O, V, 10)
007: iif(mean(V, 20) < V, -tsrank(abs(delta(C, 7)), 60) * sign(delta(C, 7)), -1)
008: p := sum(O, 5) * sum(RET, 5); -rank(p - delay(p, 10))
009: d := delta(C); iif(tmin(d, 5) > 0 or tmax(d, 5) < 0, d, -d)
010: d := delta(C); rank(iif(tmin(d, 4) > 0 or tmax(d, 4) < 0, d, -d))
011: (rank(tmax(VWAP - C, 3)) + rank(tmin(VWAP - C, 3))) * rank(delta(V, 3))
012: sign(delta(V)) * -delta(C)
013: -rank(cov(rank(C), rank(V), 5))
014: -rank(delta(RET, 3)) * corr(O, V, 10)
015: -sum(rank(corr(rank(H), rank(V), 3)), 3)
016: -rank(cov(rank(H), rank(V), 5))
017: -rank(tsrank(C, 10)) * rank(delta(delta(C))) * rank(tsrank(V / mean(V, 20), 5))
018: -rank(std(abs(C - O), 5) + C - O + corr(C, O, 10))
019: -sign(C - delay(C, 7) + delta(C, 7)) * (1 + rank(1 + sum(RET, 250)))
020: -rank(O - delay(H)) * rank(O - delay(C)) * rank(O - delay(L))
021: iif(mean(C, 8) + std(C, 8) < mean(C, 2) or V / mean(V, 20) >= 1, -1, 1)
022: -delta(corr(H, V, 5), 5) * rank(std(C, 20))
023: iif(mean(H, 20) < H, -delta(H, 2), 0)
024: iif(delta(mean(C, 100), 100) / delay(C, 100) <= 0.05, -(C - tmin(C, 100)), -delta(C, 3))
025: rank(-RET * mean(V, 20) * VWAP * (H - C))
026: -tmax(corr(tsrank(V, 5), tsrank(H, 5), 5), 3)
027: iif(rank(mean(corr(rank(V), rank(VWAP), 6), 2) / 2) > 0.5, -1, 1)
028: x := corr(mean(V, 20), L, 5) + (H + L) / 2 - C; scale(x)
029: tmin(rank(rank(log(sum(rank(rank(-rank(delta(C - 1, 5)))), 2)))), 5) + tsrank(delay(-RET, 6), 5)
030: d := delta(C); (1 - rank(sign(d) + sign(delay(d)) + sign(delay(d, 2)))) * sum(V, 5) / sum(V, 20)
031: rank(rank(rank(decay(-rank(rank(delta(C, 10))), 10)))) + rank(-delta(C, 3)) + sign(scale(corr(mean(V, 20), L, 12)))
032: scale(mean(C, 7) - C) + 20 * scale(corr(VWAP, delay(C, 5), 230))
033: rank(-1 + O / C)
034: rank(2 - rank(std(RET, 2) / std(RET, 5)) - rank(delta(C)))
035: tsrank(V, 32) * (1 - tsrank(C + H - L, 16)) * (1 - tsrank(RET, 32))
036: 2.21 * rank(corr(C - O, delay(V), 15)) + 0.7 * rank(O - C) + 0.73 * rank(tsrank(delay(-RET, 6), 5)) + rank(abs(corr(VWAP, mean(V, 20), 6))) + 0.6 * rank((mean(C, 200) - O) * (C - O))
037: rank(corr(delay(O - C), C, 200)) + rank(O - C)
038: -rank(tsrank(O, 10)) * rank(C / O)
039: -rank(delta(C, 7) * (1 - rank(decay(V / mean(V, 20), 9)))) * (1 + rank(sum(RET, 250)))
040: -rank(std(H, 10)) * corr(H, V, 10)
041: sqrt(H * L) - VWAP
042: rank(VWAP - C) / rank(VWAP + C)
043: tsrank(V / mean(V, 20), 20) * tsrank(-delta(C, 7), 8)
044: -corr(H, rank(V), 5)
045: -rank(mean(delay(C, 5), 20)) * corr(C, V, 2) * rank(corr(sum(C, 5), sum(C, 20), 2))
046: x := (delay(C, 20) - delay(C, 10)) / 10 - (delay(C, 10) - C) / 10; iif(x > 0.25, -1, iif(x < 0, 1, -delta(C)))
047: rank(1 / C) * V / mean(V, 20) * (H * rank(H - C) / mean(H, 5)) - rank(VWAP - delay(VWAP, 5))
049: iif((delay(C, 20) - delay(C, 10)) / 10 - (delay(C, 10) - C) / 10 < -0.1, 1, -delta(C))
050: -tmax(rank(corr(rank(V), rank(VWAP), 5)), 5)
051: iif((delay(C, 20) - delay(C, 10)) / 10 - (delay(C, 10) - C) / 10 < -0.05, 1, -delta(C))
052: -delta(tmin(L, 5), 5) * rank((sum(RET, 240) - sum(RET, 20)) / 220) * tsrank(V, 5)
053: -delta((C - L - (H - C)) / nz(C - L, 0.0001), 9)
054: -(L - C) * O ** 5 / (nz(L - H, -0.0001) * C ** 5)
055: -corr(rank((C - tmin(L, 12)) / (tmax(H, 12) - tmin(L, 12))), rank(V), 6)
057: -(C - VWAP) / decay(rank(argmax(C, 30)), 2)
060: -(2 * scale(rank((C - L - (H - C)) * V / (H - L))) - scale(rank(argmax(C, 10))))
061: rank(VWAP - tmin(VWAP, 16)) < rank(corr(VWAP, mean(V, 180), 18))
062: -(rank(corr(VWAP, sum(mean(V, 20), 22), 10)) < rank(rank(O) + rank(O) < rank((H + L) / 2) + rank(H)))
064: -(rank(corr(sum(O * 0.178404 + L * (1 - 0.178404), 13), sum(mean(V, 120), 13), 17)) < rank(delta((H + L) / 2 * 0.178404 + VWAP * (1 - 0.178404), 4)))
065: -(rank(corr(O * 0.00817205 + VWAP * (1 - 0.00817205), sum(mean(V, 60), 9), 6)) < rank(O - tmin(O, 14)))
066: -(rank(decay(delta(VWAP, 4), 7)) + tsrank(decay((L - VWAP) / (O - (H + L) / 2), 11), 7))
068: -(tsrank(corr(rank(H), rank(mean(V, 15)), 9), 14) < rank(delta(C * 0.518371 + L * (1 - 0.518371), 2)))
071: pmax(tsrank(decay(corr(tsrank(C, 3), tsrank(mean(V, 180), 12), 18), 4), 16), tsrank(decay(rank(L + O - 2 * VWAP) ** 2, 16), 4))
072: rank(decay(corr((H + L) / 2, mean(V, 40), 9), 10)) / rank(decay(corr(tsrank(VWAP, 4), tsrank(V, 19), 7), 3))
073: x := O * 0.147155 + L * (1 - 0.147155); -pmax(rank(decay(delta(VWAP, 5), 3)), tsrank(decay(-delta(x, 2) / x, 3), 17))
074: -(rank(corr(C, sum(mean(V, 30), 37), 15)) < rank(corr(rank(H * 0.0261661 + VWAP * (1 - 0.0261661)), rank(V), 11)))
075: rank(corr(VWAP, V, 4)) < rank(corr(rank(L), rank(mean(V, 50)), 12))
077: pmin(rank(decay((H + L) / 2 - VWAP, 20)), rank(decay(corr((H + L) / 2, mean(V, 40), 3), 6)))
078: rank(corr(sum(L * 0.352233 + VWAP * (1 - 0.352233), 20), sum(mean(V, 40), 20), 7)) ** rank(corr(rank(VWAP), rank(V), 6))
081: -(rank(log(prod(rank(rank(corr(VWAP, sum(mean(V, 10), 50), 8)) ** 4), 15))) < rank(corr(rank(VWAP), rank(V), 5)))
083: x := (H - L) / mean(C, 5); rank(delay(x, 2)) * rank(rank(V)) / (x / (VWAP - C))
084: tsrank(VWAP - tmax(VWAP, 15), 21) ** delta(C, 5)
085: rank(corr(H * 0.876703 + C * (1 - 0.876703), mean(V, 30), 10)) ** rank(corr(tsrank((H + L) / 2, 4), tsrank(V, 10), 7))
086: -(tsrank(corr(C, sum(mean(V, 20), 15), 6), 20) < rank(C - VWAP))
088: pmin(rank(decay(rank(O) + rank(L) - rank(H) - rank(C), 8)), tsrank(decay(corr(tsrank(C, 8), tsrank(mean(V, 60), 21), 8), 7), 3))
092: pmin(tsrank(decay((H + L) / 2 + C < L + O, 15), 19), tsrank(decay(corr(rank(L), rank(mean(V, 30)), 8), 7), 7))
094: -rank(VWAP - tmin(VWAP, 12)) ** tsrank(corr(tsrank(VWAP, 20), tsrank(mean(V, 60), 4), 18), 3)
095: rank(O - tmin(O, 12)) < tsrank(rank(corr(sum((H + L) / 2, 19), sum(mean(V, 40), 19), 13)) ** 5, 12)
096: -pmax(tsrank(decay(corr(rank(VWAP), rank(V), 4), 4), 8), tsrank(decay(argmax(corr(tsrank(C, 7), tsrank(mean(V, 60), 4), 4), 13), 14), 13))
098: rank(decay(corr(VWAP, sum(mean(V, 5), 26), 5), 7)) - rank(decay(tsrank(argmin(corr(rank(O), rank(mean(V, 15)), 21), 9), 7), 8))
099: -(rank(corr(sum((H + L) / 2, 20), sum(mean(V, 60), 20), 9)) < rank(corr(L, V, 6)))
101: (C - O) / (H - L + 0.001)
"""

GTJA = """
001: -corr(rank(delta(log(V))), rank((C - O) / O), 6)
002: -delta((C - L - (H - C)) / (H - L))
003: p := delay(C); sum(iif(C == p, 0, C - iif(C > p, pmin(L, p), pmax(H, p))), 6)
004: m := mean(C, 8); s := std(C, 8); t := mean(C, 2); iif(m + s < t, -1, iif(t < m - s or V / mean(V, 20) >= 1, 1, -1))
005: -tmax(corr(tsrank(V, 5), tsrank(H, 5), 5), 3)
006: -rank(sign(delta(O * 0.85 + H * 0.15, 4)))
007: rank(tmax(VWAP - C, 3)) + rank(tmin(VWAP - C, 3)) * rank(delta(V, 3))
008: rank(-delta((H + L) * 0.1 + VWAP * 0.8, 4))
009: ema(((H + L) / 2 - (delay(H) + delay(L)) / 2) * (H - L) / V, 7, 2)
010: rank(tmax(iif(RET < 0, std(RET, 20), C) ** 2, 5))
011: sum((C - L - (H - C)) / (H - L) * V, 6)
012: rank(O - sum(VWAP, 10) / 10) * -rank(abs(C - VWAP))
013: sqrt(H * L) - VWAP
014: delta(C, 5)
015: O / delay(C) - 1
016: -tmax(rank(corr(rank(V), rank(VWAP), 5)), 5)
017: rank(VWAP - tmax(VWAP, 15)) ** delta(C, 5)
018: C / delay(C, 5)
019: p := delay(C, 5); iif(C < p, (C - p) / p, iif(C == p, 0, (C - p) / C))
020: delta(C, 6) / delay(C, 6) * 100
021: slope(C, 6)
022: x := (C - mean(C, 6)) / mean(C, 6); ema(x - delta(x, 3), 12, 1)
023: p := delay(C); s := std(C, 20); u := ema(iif(C > p, s, 0), 20, 1); d := ema(iif(C <= p, s, 0), 20, 1); u / (u + d) * 100
024: ema(delta(C, 5), 5, 1)
025: -rank(delta(C, 7) * (1 - rank(decay(V / mean(V, 20), 9)))) * (1 + rank(sum(RET, 250)))
026: mean(C, 7) - C + corr(VWAP, delay(C, 5), 230)
027: a := delay(C, 3); b := delay(C, 6); decay(((C - a) / a + (C - b) / b) * 100, 12)
028: a := ema((C - tmin(L, 9)) / (tmax(H, 9) - tmin(L, 9)) * 100, 3, 1); 3 * a - 2 * ema(a, 3, 1)
029: delta(C, 6) / delay(C, 6) * V
031: (C - mean(C, 12)) / mean(C, 12) * 100
032: -sum(rank(corr(rank(H), rank(V), 3)), 3)
033: m := tmin(L, 5); (-m + delay(m, 5)) * rank((sum(RET, 240) - sum(RET, 20)) / 220) * tsrank(V, 5)
034: mean(C, 12) / C
035: -pmin(rank(decay(delta(O), 15)), rank(decay(corr(V, O, 17), 7)))
036: rank(sum(corr(rank(V), rank(VWAP), 6), 2))
037: p := sum(O, 5) * sum(RET, 5); -rank(p - delay(p, 10))
038: iif(mean(H, 20) < H, -delta(H, 2), 0)
039: rank(decay(corr(VWAP * 0.3 + O * 0.7, sum(mean(V, 180), 37), 14), 12)) - rank(decay(delta(C, 2), 8))
040: p := delay(C); sum(iif(C > p, V, 0), 26) / sum(iif(C <= p, V, 0), 26) * 100
041: -rank(tmax(delta(VWAP, 3), 5))
042: -rank(std(H, 10)) * corr(H, V, 10)
043: p := delay(C); sum(iif(C > p, V, iif(C < p, -V, 0)), 6)
044: tsrank(decay(corr(L, mean(V, 10), 7), 6), 4) / 4 + tsrank(decay(delta(VWAP, 3), 10), 15) / 15
045: rank(delta(C * 0.6 + O * 0.4)) * rank(corr(VWAP, mean(V, 150), 15))
046: (mean(C, 3) + mean(C, 6) + mean(C, 12) + mean(C, 24)) / (4 * C)
047: ema((tmax(H, 6) - C) / (tmax(H, 6) - tmin(L, 6)) * 100, 9, 1)
048: d := delta(C); -rank(sign(d) + sign(-delay(d)) + sign(-delay(d, 2))) * sum(V, 5) / sum(V, 20)
053: sum(iif(C > delay(C), 1, 0), 12) / 12 * 100
054: -rank(std(abs(C - O), 5) + C - O + corr(C, O, 10))
055: sum(pressure(55), 20)
056: rank(O - tmin(O, 12)) < rank(rank(corr(sum((H + L) / 2, 19), sum(mean(V, 40), 19), 13)) ** 5)
057: ema((C - tmin(L, 9)) / (tmax(H, 9) - tmin(L, 9)) * 100, 3, 1)
061: -pmax(rank(decay(delta(VWAP), 12)), rank(decay(rank(corr(L, mean(V, 80), 8)), 17)))
064: -pmax(rank(decay(corr(rank(VWAP), rank(V), 4), 4)), rank(decay(tmax(corr(rank(C), rank(mean(V, 60)), 4), 13), 14)))
070: std(V * VWAP, 6)
073: rank(decay(corr(VWAP, mean(V, 30), 4), 3)) - tsrank(decay(decay(corr(C, V, 10), 16), 4), 5) / 5
074: rank(corr(sum(L * 0.35 + VWAP * 0.65, 20), sum(mean(V, 40), 20), 7)) + rank(corr(rank(VWAP), rank(V), 6))
076: x := abs(RET) / V; std(x, 20) / mean(x, 20)
077: pmin(rank(decay((H + L) / 2 - VWAP, 20)), rank(decay(corr((H + L) / 2, mean(V, 40), 3), 6)))
083: -rank(cov(rank(H), rank(V), 5))
087: -(rank(decay(delta(VWAP, 4), 7)) + tsrank(decay((L - VWAP) / (O - (H + L) / 2), 11), 7) / 7)
090: -rank(corr(rank(VWAP), rank(V), 5))
091: -rank(C - pmax(C, 5)) * rank(corr(mean(V, 40), L, 5))
092: -pmax(rank(decay(delta(C * 0.35 + VWAP * 0.65, 2), 3)), tsrank(decay(abs(corr(mean(V, 180), C, 13)), 5), 15) / 15)
093: sum(iif(O < delay(O), pmax(O - L, O - delay(O)), 0), 20)
095: std(V * VWAP, 20)
098: iif((mean(C, 100) - delay(mean(C, 100), 100)) / delay(C, 100) <= 0.05, -(C - tmin(C, 100)), -(C - delay(C, 3)))
099: -rank(cov(rank(C), rank(V), 5))
101: -(rank(corr(C, sum(mean(V, 30), 37), 15)) < rank(corr(rank(H * 0.1 + VWAP * 0.9), rank(V), 11)))
104: x := corr(H, V, 5); -(x - delay(x, 4)) * rank(std(C, 20))
105: -corr(rank(O), rank(V), 10)
107: -rank(O - delay(H)) * rank(O - delay(C)) * rank(O - delay(L))
108: -(rank(H - pmin(H, 2)) ** rank(corr(VWAP, mean(V, 120), 6)))
114: x := (H - L) / mean(C, 5); rank(delay(x, 2)) * (rank(rank(V)) / (x / (VWAP - C)))
116: slope(C, 20)
119: rank(decay(corr(VWAP, sum(mean(V, 5), 26), 5), 7)) - rank(decay(tsrank(pmin(corr(rank(O), rank(mean(V, 15)), 21), 9), 7), 8))
120: rank(VWAP - C) / rank(VWAP + C)
121: -(rank(VWAP - pmin(VWAP, 12)) ** (tsrank(corr(tsrank(VWAP, 20), tsrank(mean(V, 60), 2), 18), 3) / 3))
124: r := rank(pmax(C, 30)); (C - VWAP) / ((delay(r) + 2 * r) / 3)
126: (C + H + L) / 3
127: m := pmax(C, 12); sqrt(mean((100 * (C - m) / m) ** 2, 12))
129: d := delta(C); sum(iif(d < 0, abs(d), 0), 12)
132: mean(V * VWAP, 20)
136: -rank(RET - delay(RET, 3)) * corr(O, V, 10)
137: pressure(137)
139: -corr(O, V, 10)
140: pmin(rank(decay(rank(O) + rank(L) - rank(H) - rank(C), 8)), tsrank(decay(corr(tsrank(C, 8) / 8, tsrank(mean(V, 60), 20) / 20, 8), 7), 3) / 3)
143: grow(C / delay(C) - 1)
147: slope(mean(C, 12), 12)
148: -(rank(corr(O, sum(mean(V, 60), 9), 6)) < rank(O - pmin(O, 14)))
149: f := IDX < delay(IDX); beta(iif(f, RET, null), iif(f, IDX / delay(IDX) - 1, null), 252)
150: (C + H + L) / 3 * V
153: (mean(C, 3) + mean(C, 6) + mean(C, 12) + mean(C, 24)) / 4
154: VWAP - pmin(VWAP, 16) < corr(VWAP, mean(V, 180), 18)
158: (H - L) / C
159: a := pmin(L, delay(C)); b := pmax(H, delay(C)); 100 / 504 * (288 * (C - sum(a, 6)) / sum(b - a, 6) + 144 * (C - sum(a, 12)) / sum(b - a, 12) + 144 * (C - sum(a, 24)) / sum(b - a, 24))
160: ema(iif(C <= delay(C), std(C, 20), 0), 20, 1)
161: p := delay(C); mean(pmax(pmax(H - L, abs(p - H)), abs(p - L)), 12)
164: a := iif(C > delay(C), 1 / delta(C), 1); ema(100 * (a - pmin(a, 12)) / (H - L), 13, 2)
165: s := sum(C - mean(C, 48), 48); xmax(s) - xmin(s) / std(C, 48)
167: d := delta(C); sum(iif(d > 0, d, 0), 12)
173: a := ema(C, 13, 2); b := ema(a, 13, 2); 3 * a - 2 * b + ema(b, 13, 2)
174: ema(iif(C > delay(C), std(C, 20), 0), 20, 1)
175: p := delay(C); mean(pmax(pmax(H - L, abs(p - H)), abs(p - L)), 6)
183: s := sum(C - mean(C, 24), 24); xmax(s) - xmin(s) / std(C, 24)
185: rank(-(1 - O / C) ** 2)
187: sum(iif(O > delay(O), pmax(H - O, O - delay(O)), 0), 20)
189: mean(abs(C - mean(C, 6)), 6)
"""


def _read(text: str, family: str) -> dict[str, str]:
    return {f"{family}{line[:3]}": line[4:].strip() for line in text.strip().splitlines()}


REGISTRY: dict[str, str] = _read(WQ, "wq") | _read(GTJA, "gtja")


def artifact_id(formula: str, basis: str = "qfq", version: int = 1) -> str:
    """The artifact's name: family, number, price basis and version."""
    family, number = formula.rstrip("0123456789"), formula[-3:]
    return f"{family}_alpha{number}_{basis}_v{version}"
