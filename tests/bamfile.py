"""Write small BAM files with their index, for tests."""

import struct
import zlib

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, ref, pos, flag, cigar, seq, tags=b"", mapq=60):
    n = name + b"\0"
    ops = b"".join(struct.pack("<I", (length << 4) | OPS.index(op)) for op, length in cigar)
    codes = [BASES.index(b) for b in seq] + ([0] if len(seq) % 2 else [])
    packed = bytes((codes[i] << 4) | codes[i + 1] for i in range(0, len(codes), 2))
    core = struct.pack("<iiBBHHHiiii", ref, pos, len(n), mapq, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body = core + n + ops + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def write(path, refs, records, per_block=3):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for name, length in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    out, offsets = block(head), []
    # The last record of every block runs on into the next one.
    pending = b""
    for i in range(0, len(records), per_block):
        offsets.append((len(out) << 16) | len(pending))
        data = pending + b"".join(records[i : i + per_block])
        cut = len(data) - 7
        out += block(data[:cut])
        pending = data[cut:]
    out += block(pending) + block(b"")
    with open(path, "wb") as f:
        f.write(out)
    with open(path + ".bai", "wb") as f:
        f.write(b"BAI\1" + struct.pack("<i", len(refs)))
        for r in range(len(refs)):
            if r == 0:
                f.write(struct.pack("<i", 1) + struct.pack("<Ii", 4681, len(offsets)))
                f.write(b"".join(struct.pack("<QQ", o, o + 1) for o in offsets))
                f.write(struct.pack("<i", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets))
            else:
                f.write(struct.pack("<ii", 0, 0))
