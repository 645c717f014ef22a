"""IP address syntax as one pattern."""

from pyspark.sql import functions as F

from leakgauge.functions.domain import stripped


def _v4():
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return rf"{octet}(?:\.{octet}){{3}}"


def _v6():
    """Every way of writing eight 16-bit groups, with at most one '::' and an optional IPv4 tail."""
    group, v4 = "[0-9A-Fa-f]{1,4}", _v4()
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{v4}"]
    for head in range(8):
        before = "" if head == 0 else rf"{group}(?::{group}){{{head - 1}}}"
        room = 7 - head
        tails = []
        if room >= 1:
            tails.append(rf"{group}(?::{group}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(rf"(?:{group}:){{0,{room - 2}}}{v4}")
        forms.append(f"{before}::" + (f"(?:{'|'.join(tails)})?" if tails else ""))
    return rf"(?:{'|'.join(forms)})(?:%[^%]+)?"


V4_PATTERN = rf"^{_v4()}\z"
IP_PATTERN = rf"^(?:{_v4()}|{_v6()})\z"


def is_valid_ip(col):
    text = stripped(col)
    return F.coalesce(text.rlike(V4_PATTERN) | text.rlike(IP_PATTERN), F.lit(False))
