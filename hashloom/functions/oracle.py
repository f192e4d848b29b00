"""The kernels as DuckDB expressions, for checking."""

from __future__ import annotations

from hashloom.functions import kernels as K

M64 = "18446744073709551615::UHUGEINT"


def u64(e: str) -> str:
    return f"({e})::UBIGINT"


def _mul(e: str, m: int, mask: str = M64) -> str:
    return f"((({e})::UHUGEINT * {m}::UHUGEINT) & {mask})::UBIGINT"


def _steps(key: str, steps: list[str]) -> str:
    """Each step is an expression over x, the step before; nested through lambdas."""
    e = f"[{key}]"
    for s in steps:
        e = f"list_transform({e}, lambda x: {s})"
    return f"({e})[1]"


def mix64(key: str, add: int = 0, flip: int = 0) -> str:
    x = f"xor(({key})::UBIGINT, {flip}::UBIGINT)"
    steps = [f"((x::UHUGEINT + {add}::UHUGEINT) & {M64})::UBIGINT"]
    steps += ["xor(x, x >> 30)", _mul("x", K.MIX_1), "xor(x, x >> 27)", _mul("x", K.MIX_2), "xor(x, x >> 31)"]
    return _steps(x, steps)


def splitmix64(key: str, flip: int = 0) -> str:
    return mix64(key, K.GAMMA, flip)


def kernel(name: str, key: str, p: int) -> str:
    b, m32 = K.exponent(p), f"{K.MASK32}::UHUGEINT"
    if b == 0:
        return "0::BIGINT"
    key = u64(key)
    if name == "modulo":
        return f"({key} % {p}::UBIGINT)::BIGINT"
    if name == "bitwise_and":
        return f"({key} & {p - 1}::UBIGINT)::BIGINT"
    if name == "fibonacci":
        return f"({_mul(key, K.FIBONACCI)} >> {64 - b})::BIGINT"
    if name == "murmur3_64":
        return "(" + _steps(key, ["xor(x, x >> 33)", _mul("x", K.FMIX64_1), "xor(x, x >> 33)", _mul("x", K.FMIX64_2), "xor(x, x >> 33)"]) + f" >> {64 - b})::BIGINT"
    if name == "murmur3_32":
        return "(" + _steps(key, [f"xor(x, x >> 32) & {K.MASK32}::UBIGINT", "xor(x, x >> 16)", _mul("x", K.FMIX32_1, m32), "xor(x, x >> 13)", _mul("x", K.FMIX32_2, m32), "xor(x, x >> 16)"]) + f" >> {32 - b})::BIGINT"
    if name == "tea":
        steps = [f"[(x & {K.MASK32}::UBIGINT), (x >> 32)]"]
        for r in range(1, 9):
            total = (K.TEA_DELTA * r) & K.MASK32
            for v, o, k in ((1, 2, K.TEA_KEY[:2]), (2, 1, K.TEA_KEY[2:])):
                add = f"xor(xor((x[{o}] << 4) + {k[0]}::UBIGINT, x[{o}] + {total}::UBIGINT), (x[{o}] >> 5) + {k[1]}::UBIGINT)"
                new = f"((x[{v}] + ({add} & {K.MASK32}::UBIGINT)) & {K.MASK32}::UBIGINT)"
                steps.append(f"[{new}, x[2]]" if v == 1 else f"[x[1], {new}]")
        return f"(({_steps(key, steps)})[2] >> {32 - b})::BIGINT"
    raise ValueError(name)


def wrap_sum(e: str) -> str:
    return f"(coalesce(sum(({e})::HUGEINT), 0) % 18446744073709551616::HUGEINT)::VARCHAR"
