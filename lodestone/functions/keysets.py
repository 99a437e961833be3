"""Keysets and encryption with them. A keyset is JSON text: {"primaryKeyId", "key": [{"keyId", "type", "keyBytes", "status"}]}.

A ciphertext begins with the number of its key, so that it can be read after the keyset was rotated. AEAD encryption
is AES-GCM with a fresh nonce and the additional data authenticated; deterministic encryption takes its nonce from an
HMAC of the text and the additional data, so that equal texts have equal ciphertexts. Keysets are literals, as keys
are known when a query is planned; the ciphertexts are the engine's own, not another library's wire format.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import hmac
import json
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import FUNCTIONS, col, failing, function

AEAD, DETERMINISTIC = "AEAD_AES_GCM_256", "DETERMINISTIC_AEAD_AES_SIV_CMAC_256"


def _added(keyset: dict, kind: str, raw: bytes | None = None) -> dict:
    used = {k["keyId"] for k in keyset["key"]}
    number = next(n for n in iter(lambda: secrets.randbelow(2**31 - 1) + 1, 0) if n not in used)
    key = {"keyId": number, "type": kind, "keyBytes": base64.b64encode(raw or secrets.token_bytes(32)).decode(), "status": "ENABLED"}
    return {"primaryKeyId": number, "key": [*keyset["key"], key]}


def new_keyset(kind: str) -> str:
    if kind not in (AEAD, DETERMINISTIC):
        raise ValueError(f"there is no key type {kind}")
    return json.dumps(_added({"key": []}, kind))


def add_key_from_raw_bytes(keyset: str, kind: str, raw: bytes) -> str:
    """The key is added, but the primary one stays."""
    if len(raw) not in (16, 24, 32):
        raise ValueError("a raw key has 16, 24 or 32 bytes")
    old = json.loads(keyset)
    return json.dumps(_added(old, kind, raw) | {"primaryKeyId": old["primaryKeyId"]})


def rotate_keyset(keyset: str, kind: str) -> str:
    """A new primary key; the old ones still decrypt."""
    return json.dumps(_added(json.loads(keyset), kind))


def keyset_length(keyset: str) -> int:
    return len(json.loads(keyset)["key"])


def keyset_to_json(keyset: str) -> str:
    return keyset


def keyset_from_json(text: str) -> str:
    made = json.loads(text)
    if made["primaryKeyId"] not in {k["keyId"] for k in made["key"]}:
        raise ValueError("the primary key isn't in the keyset")
    return json.dumps(made)


# wrapped keysets: a keyset encrypted by a key of a key store; here a key of bytes


def _stream(key: bytes, nonce: bytes, size: int) -> bytes:
    return b"".join(hmac.digest(key, nonce + i.to_bytes(4, "big"), "sha256") for i in range(-(-size // 32)))[:size]


def wrap(keyset: str, key: bytes) -> bytes:
    nonce, text = secrets.token_bytes(16), keyset.encode()
    sealed = bytes(a ^ b for a, b in zip(text, _stream(key, b"enc" + nonce, len(text))))
    return nonce + sealed + hmac.digest(key, b"mac" + nonce + sealed, "sha256")


def unwrap(wrapped: bytes, key: bytes) -> str:
    nonce, sealed, tag = wrapped[:16], wrapped[16:-32], wrapped[-32:]
    if not hmac.compare_digest(tag, hmac.digest(key, b"mac" + nonce + sealed, "sha256")):
        raise ValueError("the wrapped keyset is broken or the key is another")
    return bytes(a ^ b for a, b in zip(sealed, _stream(key, b"enc" + nonce, len(sealed)))).decode()


def new_wrapped_keyset(key: bytes, kind: str) -> bytes:
    return wrap(new_keyset(kind), key)


def rewrap_keyset(key: bytes, new_key: bytes, wrapped: bytes) -> bytes:
    return wrap(unwrap(wrapped, key), new_key)


def rotate_wrapped_keyset(key: bytes, wrapped: bytes, kind: str) -> bytes:
    return wrap(rotate_keyset(unwrap(wrapped, key), kind), key)


def keyset_chain(key: bytes, wrapped: bytes) -> str:
    """A keyset for the functions below, unwrapped."""
    return unwrap(wrapped, key)


# encryption


def _keys(keyset: str, kind: str) -> tuple[dict[int, bytes], int]:
    given = json.loads(keyset)
    keys = {k["keyId"]: base64.b64decode(k["keyBytes"]) for k in given["key"] if k["type"] == kind and k["status"] == "ENABLED"}
    return keys, given["primaryKeyId"]


def _bytes(x) -> Column:
    return col(x).cast("binary")


def _cipher_key(raw: bytes) -> Column:
    return F.lit(bytearray(raw if len(raw) in (16, 24, 32) else hashlib.sha256(raw).digest()))


def _primary(keyset: str, kind: str) -> tuple[Column, bytes]:
    keys, primary = _keys(keyset, kind)
    if primary not in keys:
        raise ValueError(f"the primary key isn't of the type {kind}")
    return F.lit(bytearray(primary.to_bytes(4, "big"))), keys[primary]


@function
def aead_encrypt(keyset: str, x, additional=""):
    head, key = _primary(keyset, AEAD)
    sealed = F.call_function("aes_encrypt", _bytes(x), _cipher_key(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit("")), _bytes(F.lit(additional) if additional == "" else additional))
    return F.concat(head, sealed)


def _opened(keyset: str, kind: str, x, additional, make) -> Column:
    keys, _ = _keys(keyset, kind)
    number = F.conv(F.hex(F.substring(_bytes(x), 1, 4)), 16, 10).cast("long")
    rest = F.substr(_bytes(x), F.lit(5), F.lit(1 << 30))
    found = F.when(col(x).isNull(), F.lit(None).cast("binary"))
    for own, key in keys.items():
        found = found.when(number == own, make(rest, key))
    return found.otherwise(failing("no key of the keyset fits the ciphertext").cast("binary"))


def _decrypt(rest: Column, key: bytes, additional) -> Column:
    return F.call_function("aes_decrypt", rest, _cipher_key(key), F.lit("GCM"), F.lit("DEFAULT"), _bytes(F.lit(additional) if additional == "" else additional))


@function
def aead_decrypt_bytes(keyset: str, x, additional=""):
    return _opened(keyset, AEAD, x, additional, lambda rest, key: _decrypt(rest, key, additional))


@function
def aead_decrypt_string(keyset: str, x, additional=""):
    return aead_decrypt_bytes(keyset, x, additional).cast("string")


def _nonce(key: bytes, x, additional) -> Column:
    """The first 12 bytes of an HMAC by SHA-256, in column expressions."""
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    more = _bytes(F.lit(additional) if additional == "" else additional)
    # the additional data's length keeps the two parts apart
    text = F.concat(F.lit(bytearray(inner)), F.unhex(F.lpad(F.hex(F.octet_length(more)), 8, "0")), more, _bytes(x))
    digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(text, 256))), 256))
    return F.substring(digest, 1, 12)


@function
def deterministic_encrypt(keyset: str, x, additional=""):
    head, key = _primary(keyset, DETERMINISTIC)
    more = _bytes(F.lit(additional) if additional == "" else additional)
    return F.concat(head, F.call_function("aes_encrypt", _bytes(x), _cipher_key(key), F.lit("GCM"), F.lit("DEFAULT"), _nonce(key, x, additional), more))


@function
def deterministic_decrypt_bytes(keyset: str, x, additional=""):
    return _opened(keyset, DETERMINISTIC, x, additional, lambda rest, key: _decrypt(rest, key, additional))


@function
def deterministic_decrypt_string(keyset: str, x, additional=""):
    return deterministic_decrypt_bytes(keyset, x, additional).cast("string")


for _made in (new_keyset, add_key_from_raw_bytes, rotate_keyset, keyset_length, keyset_to_json, keyset_from_json, new_wrapped_keyset, rewrap_keyset, rotate_wrapped_keyset, keyset_chain):
    FUNCTIONS[f"keys_{_made.__name__}"] = _made


def disabled(keyset: str, key_id: int) -> str:
    """The keyset with a key that no longer encrypts or decrypts."""
    made = copy.deepcopy(json.loads(keyset))
    for k in made["key"]:
        k["status"] = "DISABLED" if k["keyId"] == key_id else k["status"]
    return json.dumps(made)
