"""Functions against known vectors and literal models."""

from hypothesis import given, settings
from hypothesis import strategies as st

from deploy_analytics.functions import bytecode, hexes
from deploy_analytics.functions.keccak import keccak256_many


def test_keccak_vectors():
    got = [d.hex() for d in keccak256_many([b"", b"abc", b"transfer(address,uint256)"])]
    assert got[0] == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert got[1] == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert got[2][:8] == "a9059cbb"


def keccak_literal(data: bytes) -> bytes:
    """Keccak-256 on one message, lane by lane."""
    mask = (1 << 64) - 1
    rol = lambda v, n: ((v << n) | (v >> (64 - n))) & mask if n else v
    size = (len(data) // 136 + 1) * 136
    padded = bytearray(data + b"\1" + bytes(size - len(data) - 1))
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, size, 136):
        for i in range(17):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        register = 1
        for _ in range(24):
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            a = [[a[x][y] ^ c[x - 1] ^ rol(c[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
            x, y, lane = 1, 0, a[1][0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                a[x][y], lane = rol(lane, (t + 1) * (t + 2) // 2 % 64), a[x][y]
            a = [[a[x][y] ^ (~a[(x + 1) % 5][y] & a[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            for j in range(7):
                if register & 1:
                    a[0][0] ^= 1 << ((1 << j) - 1)
                register = (register << 1) ^ (0x171 if register & 0x80 else 0)
    return b"".join(a[x][0].to_bytes(8, "little") for x in range(4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=12))
def test_keccak_any_rows(rows):
    assert keccak256_many(rows) == [keccak_literal(r) for r in rows]


def test_trailers():
    parse = bytecode.parse_trailer
    assert parse(bytes.fromhex("a164736f6c6343000814")) == ("solidity", "0.8.20", False)
    assert parse(bytes.fromhex("ba99b6265700")) == (None, None, False)
    assert parse(bytes.fromhex("a2646970667342aabb64736f6c6343000811")) == ("solidity", "0.8.17", True)
    assert parse(bytes.fromhex("a2657679706572440003070164736f6c634100")) == ("solidity", None, False)
    assert parse(bytes.fromhex("a1657679706572f5")) == ("vyper", None, False)
    assert parse(bytes.fromhex("a1636162631bffff")) == ("other", None, False)
    assert parse(b"\xa0") == (None, None, False)
    assert parse(bytes.fromhex("a164736f6c634300")) == (None, None, False)
    assert parse(bytes.fromhex("a1616142ff")) == (None, None, False)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_any_trailer_parses(data):
    language, version, sourced = bytecode.parse_trailer(data)
    assert language in (None, "solidity", "vyper", "other") and isinstance(sourced, bool)
    assert version is None or language in ("solidity", "vyper")


def walk(code: bytes) -> list[str]:
    out, at = [], 0
    while at < len(code):
        n = code[at] - 0x5F if 0x60 <= code[at] <= 0x7F else 0
        out.append(code[at : at + 1 + n].hex().upper())
        at += 1 + n
    return out


def test_opcode_walk(spark):
    import random

    random.seed(2)
    codes = [bytes(random.choices([random.randrange(256), 0x60, 0x7F, 0x63], k=random.randrange(1, 300))) for _ in range(200)]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(codes)], "i int, code binary")
    for r in rows.select("i", bytecode.opcodes(rows.code).alias("ops")).collect():
        assert r.ops == walk(codes[r.i])


def test_decoding_literals(spark):
    minimal = "363d3d373d3d3d363d73" + "11" * 20 + "5af43d82803e903d91602b57fd5bf3"
    erc20 = "6318160ddd63a9059cbb63dd62ed3e"
    cases = {
        "push0": "5f00", "erc20": erc20, "in data": "62" + "a9059c" + "bb", "solc": "6000" + "a164736f6c6343000814" + "000a",
        "minimal": minimal, "near miss": minimal[:-2], "absurd": "ba99b626570005", "slot": "7f360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc",
    }
    df = spark.createDataFrame([(k, bytearray.fromhex(v)) for k, v in cases.items()], "k string, code binary")
    got = {r.k: r for r in bytecode.analyzed(df).collect()}
    assert got["push0"].uses_push0 and not got["erc20"].uses_push0
    assert got["erc20"].is_erc20 and not got["in data"].is_erc20
    assert got["solc"].compiler_version == "0.8.20" and got["solc"].language == "solidity"
    assert got["minimal"].is_proxy_minimal and not got["near miss"].is_proxy_minimal
    assert got["absurd"].language is None
    assert got["slot"].is_proxy_eip1967


def test_hex(spark):
    df = spark.createDataFrame([("0xAb",), (r"\xab",), (r"\\xab",), ("abc",), ("zz",), (None,), ("0x",)], "t string")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(hexes.from_hex(df.t)).collect()] == [b"\xab", b"\xab", b"\xab", None, None, None, b""]
