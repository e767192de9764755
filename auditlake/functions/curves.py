"""Public keys of elliptic-curve private keys, by scalar multiplication in plain integers, with one inverse for each key."""

from __future__ import annotations

import hashlib

# The prime, the coefficient a and the base point of each named curve, by the DER content of its identifier.
CURVES = {
    bytes.fromhex("2b81040021"): (  # P-224
        2**224 - 2**96 + 1,
        -3,
        0xB70E0CBD6BB4BF7F321390B94A03C1D356C21122343280D6115C1D21,
        0xBD376388B5F723FB4C22DFE6CD4375A05A07476444D5819985007E34,
    ),
    bytes.fromhex("2b8104000a"): (  # secp256k1
        2**256 - 2**32 - 977,
        0,
        0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798,
        0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8,
    ),
    bytes.fromhex("2a8648ce3d030107"): (  # P-256
        2**256 - 2**224 + 2**192 + 2**96 - 1,
        -3,
        0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
        0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5,
    ),
    bytes.fromhex("2b81040022"): (  # P-384
        2**384 - 2**128 - 2**96 + 2**32 - 1,
        -3,
        0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7,
        0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F,
    ),
    bytes.fromhex("2b81040023"): (  # P-521
        2**521 - 1,
        -3,
        0x00C6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66,
        0x011839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650,
    ),
}
P25519 = 2**255 - 19
D25519 = -121665 * pow(121666, -1, P25519) % P25519
BASE25519 = (0x216936D3CD6E53FEC0A4E231FDD6DC5C692CC7609525A7B2C9562D608F25D51A, 0x6666666666666666666666666666666666666666666666666666666666666658)




def multiply(n: int, point, zero, add, double):
    """n times a point, for n of at least 0: four bits of n at a time, by a table of the point's first fifteen multiples."""
    table = [zero, point]
    while len(table) < 16:
        table.append(add(table[-1], point))
    out = zero
    for at in range((n.bit_length() + 3) // 4 * 4 - 4, -1, -4):
        for _ in range(4):
            out = double(out)
        if digit := n >> at & 15:
            out = add(out, table[digit])
    return out


def _jacobian(p: int, a: int):
    """(add, double) of points (x/z^2, y/z^3), which need no inverse; z is 0 at infinity."""

    def double(point):
        x, y, z = point
        if not y or not z:
            return 1, 1, 0
        yy, zz = y * y % p, z * z % p
        s = 4 * x * yy % p
        m = (3 * x * x + a * zz * zz) % p
        u = (m * m - 2 * s) % p
        return u, (m * (s - u) - 8 * yy * yy) % p, 2 * y * z % p

    def add(one, two):
        if not one[2] or not two[2]:
            return two if not one[2] else one
        (x1, y1, z1), (x2, y2, z2) = one, two
        zz1, zz2 = z1 * z1 % p, z2 * z2 % p
        u1, u2, s1, s2 = x1 * zz2 % p, x2 * zz1 % p, y1 * zz2 * z2 % p, y2 * zz1 * z1 % p
        if u1 == u2:
            return double(one) if s1 == s2 else (1, 1, 0)
        h, r = u2 - u1, s2 - s1
        hh = h * h % p
        hhh, v = h * hh % p, u1 * hh % p
        x = (r * r - hhh - 2 * v) % p
        return x, (r * (v - x) - s1 * hhh) % p, h * z1 * z2 % p

    return add, double


def uncompressed_point(curve: bytes, secret: int) -> bytes:
    """The public point of a secret on a named curve: 04, x, y. ValueError for an unknown curve or a secret without a point."""
    if curve not in CURVES:
        raise ValueError("unknown curve")
    p, a, x, y = CURVES[curve]
    size = (p.bit_length() + 7) // 8
    if not 0 < secret < 1 << 8 * size:
        raise ValueError("no public point")
    u, v, z = multiply(secret, (x, y, 1), (1, 1, 0), *_jacobian(p, a))
    if not z:
        raise ValueError("no public point")
    w = pow(z, -1, p)
    return b"\4" + (u * w * w % p).to_bytes(size, "big") + (v * w * w * w % p).to_bytes(size, "big")


def ed25519_public(seed: bytes) -> bytes:
    """The 32 bytes of the public key of an Ed25519 seed."""
    if len(seed) != 32:
        raise ValueError("a seed has 32 bytes")
    p = P25519

    def add(one, two):
        # Points (x/z, y/z) with t = xy/z; the law holds for equal points too.
        (x1, y1, z1, t1), (x2, y2, z2, t2) = one, two
        a, b, c, d = (y1 - x1) * (y2 - x2) % p, (y1 + x1) * (y2 + x2) % p, 2 * t1 * D25519 * t2 % p, 2 * z1 * z2 % p
        e, f, g, h = b - a, d - c, d + c, b + a
        return e * f % p, g * h % p, f * g % p, e * h % p

    low = int.from_bytes(hashlib.sha512(seed).digest()[:32], "little")
    x, y = BASE25519
    u, v, z, _ = multiply(low & (1 << 254) - 8 | 1 << 254, (x, y, 1, x * y % p), (0, 1, 1, 0), add, lambda q: add(q, q))
    w = pow(z, -1, p)
    return (v * w % p | (u * w % p & 1) << 255).to_bytes(32, "little")
