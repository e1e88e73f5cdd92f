"""Two words that have equal hashes under any polynomial modulo 2^64 of their characters."""


def pair() -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
