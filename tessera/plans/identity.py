"""Request identity: SHA-256 of a value's canonical JSON (sorted keys, shortest numbers, no white space)."""

from __future__ import annotations

import hashlib
import json
import math


def canonical(value: object) -> str:
    """Canonical JSON. Keys are sorted by UTF-16 units; numbers are written as ECMAScript writes them."""
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys are strings")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("numbers are finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        if abs(x) >= 1e-6:
            return repr(x)
        digits = repr(x).lstrip("-").replace("0.", "", 1)
        zeros = len(digits) - len(digits.lstrip("0"))
        digits, exponent = digits.lstrip("0"), str(-zeros - 1)
        mantissa = ("-" if x < 0 else "") + digits[0] + ("." + digits[1:] if digits[1:] else "")
    e = int(exponent)
    if -7 < e < 0:
        sign, digits = ("-" if x < 0 else ""), mantissa.lstrip("-").replace(".", "")
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return f"{mantissa}e{'+' if e > 0 else '-'}{abs(e)}"


def digest_of(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()
