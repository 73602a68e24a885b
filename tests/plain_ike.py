"""The payload decoder one message at a time, to compare the batch decoder with."""

from culvert.sources.headers import FLAG_V1_ENCRYPTED, IKE_HEADER, V1

# Lengths of the three nested headers (RFC 7296 s3.2, s3.3.1, s3.3.2; RFC 2408 s3.2, s3.5, s3.6 have the
# same layout), payload types, and the least body of payloads whose fields are read.
PAYLOAD, PROPOSAL, TRANSFORM = 4, 8, 8
SA, KE, AUTH, NOTIFY, VENDOR, SEALED = 33, 34, 39, 41, 43, 46
V1_SA, V1_VENDOR, QUICK_MODE = 1, 13, 32
LEAST_BODY = {34: 4, 35: 4, 36: 4, 39: 4, 41: 4}
TRANSFORM_FIELDS = {1: "encr_id", 2: "prf_id", 3: "integ_id", 4: "dh_id"}
MORE_EXCHANGES = range(6, 13)
CHILD_EXCHANGES, CHILD_PROTOCOLS = (35, 36), (2, 3)
PHASE_1 = {1: "v1_encr", 2: "v1_hash", 3: "v1_auth", 4: "v1_group", 11: "life_type", 12: "life_value", 14: "key_length"}
PHASE_2 = {1: "life_type", 2: "life_value", 3: "p2_group", 4: "encap", 5: "esp_auth", 6: "key_length"}
KEY_LENGTH = 14

#: what may be wrong with a run of framed parts
SHORT, LENGTH, LEFT = "short", "length", "left over"


def number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def parts(data: bytes, head: int, kind: int) -> tuple[list[tuple[int, bytes, bytes]], str | None]:
    """The framed parts of ``data`` as (kind, header, body), and what is wrong with the rest.

    Payloads, proposals and transforms are framed alike: the first byte says what follows (0: nothing), the third and
    fourth hold the length with the header. ``kind`` is what the first part is. A sealed payload is always the last.
    """
    found = []
    while kind:
        size = number(data[2:4])
        fault = SHORT if len(data) < min(head, 4) else LENGTH if not head <= size <= len(data) else None
        if fault:
            return found, fault
        found.append((kind, data[:head], data[head:size]))
        kind, data = (0 if head == PAYLOAD and kind == SEALED else data[0]), data[size:]
    return found, LEFT if data else None


def values(data: bytes, variable: bool) -> dict[int, int]:
    """Attributes by type: fixed ones, and with ``variable`` those of up to eight bytes."""
    out = {}
    while len(data) >= 4:
        tag, word = number(data[:2]), number(data[2:4])
        fixed = tag >> 15
        body, data = (b"", data[4:]) if fixed else (data[4 : 4 + word], data[4 + word :])
        if fixed or variable and 1 <= len(body) <= 8:
            out[tag & 0x7FFF] = word if fixed else number(body)
    return out


def offers(body: bytes) -> tuple[list[tuple[int, list[tuple[bytes, bytes]]]], str | None]:
    """(protocol, transforms as header and attributes) of each proposal; the SPI before the transforms is skipped."""
    proposals, fault = parts(body, PROPOSAL, int(len(body) >= PROPOSAL))
    out = []
    for _, head, inner in proposals:
        inner = inner[head[6] :]
        transforms, wrong = parts(inner, TRANSFORM, int(len(inner) >= TRANSFORM))
        fault = fault or (wrong if wrong == LENGTH else None)
        out.append((head[5], [(h, b) for _, h, b in transforms]))
    return out, fault if fault == LENGTH else None


def readable(data: bytes, kind: int) -> list[tuple[int, bytes]]:
    """Payloads of bytes that frame without a fault and hold what their types need: not encrypted. Else none."""
    found, fault = parts(data, PAYLOAD, kind)
    sound = all(len(b) >= LEAST_BODY.get(k, 0) and not (k == SA and offers(b)[1]) for k, _, b in found)
    return [(k, b) for k, _, b in found] if sound and not fault else []


def decode(message: bytes) -> dict:
    """Fields of one message; a fault in the framing sets ``truncated`` and keeps what was framed before it."""
    out = {"payload_types": [], "truncated": number(message[24:28]) > len(message), "encrypted": False, "addke_ids": [], "notify_types": [], "vids": [], "n_transforms": 0, "ke_len": 0}
    first, version, exchange, flags = message[16:20]
    body = message[IKE_HEADER:]
    if version == V1 and flags & FLAG_V1_ENCRYPTED:
        found = readable(body, first)
        out["encrypted"] = not found and (bool(body) or first > 0)
    else:
        framed, fault = parts(body, PAYLOAD, first)
        out["truncated"] |= fault in (SHORT, LENGTH)
        found = [(k, b) for k, _, b in framed]
        if framed and framed[-1][0] == SEALED:
            found += readable(framed[-1][2], framed[-1][1][0])
    out["payload_types"] = [k for k, _ in found]
    (_v1_fields if version == V1 else _v2_fields)(out, found, exchange)
    return out


def _bodies(found: list[tuple[int, bytes]], kind: int) -> list[bytes]:
    return [b for k, b in found if k == kind and len(b) >= LEAST_BODY.get(k, 0)]


def _v2_fields(out: dict, found: list[tuple[int, bytes]], exchange: int) -> None:
    exchanged, proofs = _bodies(found, KE), _bodies(found, AUTH)
    out |= {"notify_types": [number(b[2:4]) for b in _bodies(found, NOTIFY)], "vids": [b.hex() for b in _bodies(found, VENDOR)]}
    if exchanged:
        out |= {"ke_group": number(exchanged[0][:2]), "ke_len": len(exchanged[0]) - 4}
    if proofs:
        out["auth_id"] = proofs[0][0]
    read = [offers(b) for b in _bodies(found, SA)]
    made = [o[0] for o, fault in read if o and not fault]
    if exchange in CHILD_EXCHANGES:  # what is negotiated here is a child, if one is offered at all
        made = [o for o in made if o[0] in CHILD_PROTOCOLS] or made
    if made:
        protocol, transforms = made[0]
        out |= {"proposal_protocol": protocol, "n_transforms": len(transforms)}
        for head, attributes in reversed(transforms):  # of several alternatives the first stays
            if head[4] in TRANSFORM_FIELDS:
                out[TRANSFORM_FIELDS[head[4]]] = number(head[6:8])
            if head[4] == 1:
                out["key_length"] = values(attributes, False).get(KEY_LENGTH)
        out["addke_ids"] = [number(h[6:8]) for h, _ in transforms if h[4] in MORE_EXCHANGES]


def _v1_fields(out: dict, found: list[tuple[int, bytes]], exchange: int) -> None:
    out["vids"] = [b.hex() for b in _bodies(found, V1_VENDOR)]
    associations = _bodies(found, V1_SA)
    if not associations:
        return
    made, fault = offers(associations[0][8:])  # behind domain and situation
    if fault or not made or not made[0][1]:
        out["error"] = "SA: " + (fault or SHORT)
        return
    head, attributes = made[0][1][0]
    quick = exchange == QUICK_MODE
    if quick:
        out["esp_id"] = head[5]
    names = PHASE_2 if quick else PHASE_1
    out |= {names[tag]: value for tag, value in values(attributes, True).items() if tag in names}
