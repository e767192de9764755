"""Public keys of private keys, and their match with certificates of localhost."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.catalogue_rules import certificate, der, pem
from auditlake.functions import curves, secrets as shapes
from auditlake.operators import secrets

LABEL = "PRIVATE" + " KEY"
#: The orders of three base points.
ORDERS = {
    "2b81040021": 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFF16A2E0B8F03E13DD29455C5C2A3D, "2b8104000a": 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141,
    "2a8648ce3d030107": 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551,
}


def by_chords(curve: bytes, n: int) -> bytes:
    """The uncompressed point by the affine addition law, an inverse for each step."""
    p, a, x, y = curves.CURVES[curve]

    def add(one, two):
        if one is None or two is None:
            return one or two
        if one[0] == two[0] and (one[1] + two[1]) % p == 0:
            return None
        slope = (3 * one[0] * one[0] + a) * pow(2 * one[1], -1, p) if one == two else (two[1] - one[1]) * pow(two[0] - one[0], -1, p)
        u = (slope * slope - one[0] - two[0]) % p
        return u, (slope * (one[0] - u) - one[1]) % p

    out, point = None, (x, y)
    while n:
        out, point, n = add(out, point) if n & 1 else out, add(point, point), n >> 1
    return b"\4" + b"".join(v.to_bytes((p.bit_length() + 7) // 8, "big") for v in out)


@pytest.mark.parametrize("curve", curves.CURVES, ids=bytes.hex)
def test_points_equal_those_by_chords(curve):
    draw, p = random.Random(1), curves.CURVES[curve][0]
    for n in (1, 2, 3, 15, 16, 17, 256, draw.getrandbits(p.bit_length() - 1), draw.getrandbits(p.bit_length() // 2)):
        assert curves.uncompressed_point(curve, n) == by_chords(curve, n)
    for n in (0, ORDERS.get(curve.hex(), 0), -1):
        with pytest.raises(ValueError):
            curves.uncompressed_point(curve, n)


def test_ed25519():
    """The first test vector of RFC 8032."""
    assert curves.ed25519_public(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"


def test_keys_of_every_algorithm_match_their_certificates(spark):
    names, texts, held = [(0x82, b"localhost")], [], []
    for i, curve in enumerate(curves.CURVES):
        size = (curves.CURVES[curve][0].bit_length() + 7) // 8
        secret = random.Random(i).getrandbits(8 * size - 9)
        texts.append(pem("EC " + LABEL, der(0x30, der(2, b"\1"), der(4, secret.to_bytes(size, "big")), der(0xA0, der(6, curve)))))
        held.append(certificate(["localhost"], names, der(6, secrets.EC) + der(6, curve), by_chords(curve, secret)))
    modulus, exponent = b"\0" + bytes(range(129, 257 - 1)) + b"\xf1", b"\1\0\1"
    texts.append(pem("RSA " + LABEL, der(0x30, der(2, b"\0"), der(2, modulus), der(2, exponent), *[der(2, b"\3")] * 6)))
    held.append(certificate(["localhost"], names, der(6, secrets.RSA) + der(5, b""), der(0x30, der(2, modulus), der(2, exponent))))
    stranger = pem("EC " + LABEL, der(0x30, der(2, b"\1"), der(4, b"\7" * 32), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107")))))
    # Each key stands twice in each of twenty files; certificates of another repository don't count.
    rows = [("one", f"{i}/{j}.key", f"x\n{t}\n{t}") for i, t in enumerate([*texts, stranger]) for j in range(20)] + [("two", "a.key", texts[0])]
    keys = spark.createDataFrame(rows, "repo_id string, path string, content string")
    found = secrets.test_keys(keys, spark.createDataFrame([("one", f"{i}.pem", c) for i, c in enumerate(held)], keys.schema))
    got = found.groupBy("repo_id", F.split_part("key_path", F.lit("/"), F.lit(1)).alias("i")).agg(F.count("*").alias("n")).collect()
    assert {(r["repo_id"], r["i"], r["n"]) for r in got} == {("one", str(i), 40) for i in range(len(texts))}


def test_a_url_password_is_placed_where_it_is_met_first():
    same = "Zx81-Pq47-Lm02-Vb33"
    [(_, start, end, *_)] = [c for c in shapes.candidates(f"https://{same}:{same}@h.test/") if c[3] == "credential-url"]
    assert (start, end) == (8, 8 + len(same))
    [(_, start, *_)] = [c for c in shapes.candidates(f"https://user:{same}@h.test/") if c[3] == "credential-url"]
    assert start == len("https://user:")
