"""Labels, taxonomies, decisions and rejection rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BENIGN, UNKNOWN = "Benign", "Unknown"

#: Fixed values: (kind of test, words, family), first match wins; compared in lower case.
TAXONOMIES = {
    "keyword": [
        ("starts", ["benign"], "Benign"), ("contains", ["ddos"], "DDoS"), ("contains", ["dos"], "DoS"), ("contains", ["botnet", "mirai"], "Botnet"),
        ("contains", ["recon", "scan", "port"], "Scan/Recon"), ("contains", ["brute", "patator"], "BruteForce"), ("contains", ["web", "http", "xss", "sql"], "Web/App"),
    ],
    "host_flows": [
        ("is", ["benign"], "Benign"), ("contains", ["ddos"], "DDoS"), ("contains", ["dos"], "DoS"), ("contains", ["portscan", "scan"], "Scan/Recon"),
        ("contains", ["patator", "brute"], "BruteForce"), ("contains", ["web attack", "xss", "sql"], "Web/App"), ("contains", ["botnet"], "Botnet"),
    ],
    "connection_records": [
        ("is", ["normal", "benign", "normaltraffic"], "Benign"),
        ("is", ["back", "land", "neptune", "pod", "smurf", "teardrop", "mailbomb", "apache2", "processtable", "udpstorm"], "DoS"),
        ("is", ["ipsweep", "nmap", "portsweep", "satan", "mscan", "saint"], "Probe"),
        ("is", ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster", "sendmail", "named", "snmpgetattack", "snmpguess", "xlock", "xsnoop", "worm"], "R2L"),
        ("is", ["buffer_overflow", "loadmodule", "perl", "rootkit", "ps", "sqlattack", "xterm", "httptunnel"], "U2R"),
    ],
    "category": [("is", ["normal", "benign"], "Benign"), ("is", ["", "nan", "none"], "Other")],
}


def fine_label(c: Column, strip_period: bool = False) -> Column:
    t = F.trim(c)
    return F.replace(t, F.lit("."), F.lit("")) if strip_period else t


def family_of(label: Column, taxonomy: str) -> Column:
    """Ordered rules of a taxonomy; unmatched labels are Other, except in `category`, which keeps them."""
    text = F.trim(F.coalesce(label, F.lit("")))
    low = F.lower(F.replace(text, F.lit("."), F.lit("")))
    test = {"is": lambda w: low == w, "starts": lambda w: low.startswith(w), "contains": lambda w: low.contains(w)}
    rest = text if taxonomy == "category" else F.lit("Other")
    for kind, words, family in reversed(TAXONOMIES.get(taxonomy, [])):
        rest = F.when(reduce(lambda a, b: a | b, [test[kind](w) for w in words]), family).otherwise(rest)
    return rest


def is_attack(family: Column) -> Column:
    return (family != BENIGN).cast("int")


def closed_truth(attack: Column, family: Column) -> Column:
    return F.when(attack == 0, BENIGN).otherwise(family)


def open_truth(attack: Column, family: Column, holdout: Column, known: list[str]) -> Column:
    """Held-out and unseen families are Unknown."""
    return F.when(attack == 0, BENIGN).when(family == holdout, UNKNOWN).when(family.isin(known), family).otherwise(UNKNOWN)


def decide(p: Column, pmax: Column, family: Column, threshold: float | Column, tau: float | Column, use_unknown: bool = True) -> Column:
    """Two-stage decision; both comparisons are strict."""
    tau_ = tau if isinstance(tau, Column) else F.lit(float(tau))
    threshold_ = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    reject = (pmax < tau_) if use_unknown else F.lit(False)
    return F.when(p < threshold_, BENIGN).when(reject, UNKNOWN).otherwise(family)


def abstain(decision: Column, policy: str) -> tuple[Column, Column]:
    """(decision, rejected): `abstain` keeps Unknown, `reject_to_benign` turns it into Benign."""
    rejected = decision == UNKNOWN
    return (F.when(rejected, BENIGN).otherwise(decision) if policy == "reject_to_benign" else decision), rejected


def rejector(method: str, p: Column, pmax: Column, margin: Column, entropy: Column, family: Column, threshold: float, cut: float | Column) -> tuple[Column, Column, Column]:
    """(decision, rejected, uncertainty) of control_tau, margin_reject, entropy_reject or conformal_reject.

    Rows below the first stage's threshold are Benign, never rejected, with uncertainty 0. For conformal_reject `cut`
    is the predicted family's threshold (missing: 0).
    """
    cut_ = cut if isinstance(cut, Column) else F.lit(float(cut))
    cut_ = F.coalesce(cut_, F.lit(0.0))
    rule, doubt = {
        "control_tau": (pmax < cut_, 1 - pmax),
        "margin_reject": (margin < cut_, 1 - margin),
        "entropy_reject": (entropy > cut_, entropy),
        "conformal_reject": (pmax < cut_, cut_ - pmax),
    }[method]
    gated = p < threshold
    decision = F.when(gated, BENIGN).when(rule, UNKNOWN).otherwise(family)
    return decision, ~gated & rule, F.when(gated, 0.0).otherwise(doubt)


def sink_aware(p: Column, pmax: Column, margin: Column, family: Column, sink: Column | str, threshold: float, tau: float | Column, sink_tau: float | Column, floor: float | Column) -> Column:
    """Rejects below tau, and in the sink family also below its own tau or margin."""
    reject = (pmax < tau) | ((family == sink) & ((pmax < sink_tau) | (margin < floor)))
    return F.when(p < threshold, BENIGN).when(reject, UNKNOWN).otherwise(family)


def holdout_case(detection: Column, false_unknown: Column) -> Column:
    return (
        F.when(detection.isNull() | false_unknown.isNull(), "unknown")
        .when((detection >= 0.75) & (false_unknown <= 0.01), "strong case")
        .when(detection < 0.10, "hard failure case")
        .otherwise("mixed case")
    )


def delta_band(delta: Column, small: float = 0.005, large: float = 0.02) -> Column:
    return F.when(delta.isNull(), "n/a").when(delta >= large, "gain").when(delta >= small, "slight gain").when(delta > -small, "level").when(delta > -large, "slight loss").otherwise("loss")


#: Whole names that identify a record or a moment; kinds of endpoints, their sides, and endings of moments.
LEAKAGE_NAMES = ["id", "row_id", "record_id", "flow_id", "flowid", "flow_identifier", "packet_id", "session_id", "time", "datetime", "sport", "dsport"]
ENDPOINT_KINDS, ENDPOINT_SIDES, MOMENTS = ["ip", "port"], ["src", "dst", "source", "dest", "local"], ["time", "ts", "date"]


def leakage_column(name: Column) -> Column:
    """Whether a canonical column name tells an identifier, a moment or an endpoint: kinds x sides over the name's parts."""
    parts = F.split(name, "_")
    sided = reduce(lambda a, b: a | b, [name.contains(side) for side in ENDPOINT_SIDES])
    endpoint = [F.array_contains(parts, kind) | (name.contains(kind) & sided) for kind in ENDPOINT_KINDS]
    moment = name.contains("timestamp") | ((F.size(parts) > 1) & F.element_at(parts, -1).isin(MOMENTS))
    return reduce(lambda a, b: a | b, endpoint, name.isin(LEAKAGE_NAMES) | moment | name.endswith("ip_dec"))


#: Weights of words in column names that hint at identifiers.
LEAKAGE_WORDS = {
    "flow_id": 5, "id": 3, "src_ip": 5, "dst_ip": 5, "ip": 4, "address": 3, "mac": 4, "src_port": 4, "dst_port": 4,
    "port": 3, "timestamp": 5, "time": 3, "date": 3, "local": 2,
}


def leakage_score(name: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(name.contains(w), s).otherwise(0) for w, s in LEAKAGE_WORDS.items()])
