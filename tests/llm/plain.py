"""Plain forms of what the operators must find."""

import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(d)) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, expr) in enumerate(BASE.items()):
        for m in re.finditer(expr, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


SECRETS = {
    "assign": (r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_secrets(text):
    """Base spans of secrets, as the contract words them."""
    out = [(m.start(), k, kind, m.end()) for k, (kind, (expr, fits)) in enumerate(SECRETS.items()) for m in re.finditer(expr, text) if fits(m)]
    return [(kind, a, z) for a, _, kind, z in sorted(out)]
