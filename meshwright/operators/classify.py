"""Rule-based classification of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a role, by rule: words, role, family, geometry ('' for any), priority.
RULES = (
    (("power cable", "power distribution", "power distribusi", "power out", "pln distribution", "feeder pln", "pln feeder", "power feeder", "kabel power", "power pln", "pln power", "pln", "listrik"), "cable_path", "infrastructure", "linestring", 10),
    (("cctv cable", "kabel cctv", "backbone cctv"), "cable_path", "cctv", "", 10),
    (("fiber optic", "fibre optic", "jalur fo", "fo rekomendasi"), "cable_path", "fiber_optic", "", 10),
    (("lan", "utp", "jaringan lan"), "cable_path", "lan", "linestring", 10),
    (("junction box", "juction box", "jucntion box", "jb cctv", "jb"), "device_node", "cctv", "point", 40),
    (("patch panel",), "device_node", "infrastructure", "point", 30),
    (("otb", "optical termination box"), "device_node", "fiber_optic", "point", 30),
    (("server rack", "rack server", "svr office"), "device_node", "infrastructure", "point", 100),
    (("pln source", "power source", "power panel", "pln"), "device_node", "infrastructure", "point", 10),
    (("cctv", "camera", "kamera"), "device_node", "cctv", "point", 10),
    (("nvr",), "device_node", "infrastructure", "point", 30),
    (("tiang", "pole", "pylon"), "device_node", "infrastructure", "point", 10),
    (("switch", "server", "router", "otb", "rack", "core"), "device_node", "infrastructure", "point", 30),
    (("access point", "printer", "peripheral"), "device_node", "lan", "point", 10),
    (("coverage", "cakupan", "area layanan"), "coverage_area", "infrastructure", "", 10),
    (("visual only", "dekorasi", "annotation"), "visual_only", "unknown", "", 10),
)


def first_rule(tokens: str | Column, kinds: str | Column) -> Column:
    """struct(role, family, rule) of the rule that applies to these columns: highest priority, longest word, first head; null for none.

    All rules are weighed in one expression, in the order of precedence, so no
    join and no ranking is needed.
    """
    tokens, kinds = (c if isinstance(c, str) else c._jc.node().sql() for c in (tokens, kinds))
    order = sorted(range(len(RULES)), key=lambda k: (-RULES[k][4], -max(map(len, RULES[k][0])), RULES[k][0][0]))
    hit = lambda w: f"contains(concat(' ', {tokens}, ' '), ' {w} ')" if len(w) <= 3 else f"contains({tokens}, '{w}')"
    tests = []
    for k in order:
        words, role, family, kind, _ = RULES[k]
        told = f"({' or '.join(map(hit, dict.fromkeys(words)))})" + (f" and array_contains({kinds}, '{kind}')" if kind else "")
        tests.append(f"when {told} then named_struct('role', '{role}', 'family', '{family}', 'rule', {k})")
    return F.expr(f"case {' '.join(tests)} end")
