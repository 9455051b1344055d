"""Rule lists, clusterings and results as XML; these are small and handled on the driver."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from datetime import datetime
from xml.sax.saxutils import escape

from marlstone.operators.classify import Evaluation
from marlstone.operators.cluster import Attribute, Centroid, ClusterModel
from marlstone.operators.rules import EQ, GT, LE, NEQ, Literal, Rule, words
from marlstone.operators.tables import CONTINUOUS, DISCRETE

# Fixed values of the file formats, as are the elements and their order in the functions below. Names of the operators' elements, and of two more that readers meet:
OPERATOR_OF = {"eq": EQ, "neq": NEQ, "lwreq": LE, "grt": GT}
ALSO_READ = {"lwr": LE, "grteq": GT}
# Names of the programs that files say they come from:
MINED, GROWN, TESTED = "ASSOC_RULES_CLASSIFIER", "FOIL", "RULES_CLASSIFIER"
NAME_OF = {op: name for name, op in OPERATOR_OF.items()}


def _literal_xml(x: Literal) -> str:
    value = escape(x.value) if x.kind == DISCRETE else repr(x.value)
    return f'<att type="{x.kind}">{escape(x.attr)}<{NAME_OF[x.op]}/>{value}</att>'


def rule_xml(r: Rule, counts: bool = False) -> str:
    """One rule; with counts, also its coverage, support and confidence."""
    body = "".join(f"\t\t{_literal_xml(x)}\n" for x in r.body)
    extra = f"\t<ex>{r.freq}</ex>\n\t<sup>{r.pos}</sup>\n\t<conf>{r.conf!r}</conf>\n" if counts else ""
    return f"<rule>\n\t<body>\n{body}\t</body>\n\t{_literal_xml(r.head)}\n{extra}</rule>\n"


def rules_xml(rules: list[Rule], algorithm: str = MINED, counts: bool = False) -> str:
    return f"<rules_classifier_file>\n\t<algo>{escape(algorithm)}</algo>\n\n<rule_list>\n" + "".join(rule_xml(r, counts) for r in rules) + "</rule_list>\n\n</rules_classifier_file>"


def _parse_literal(e: ET.Element) -> Literal:
    if e.get("type") not in (DISCRETE, CONTINUOUS) or len(e) != 1:
        raise ValueError("an att has a type of d or c and one operator")
    op = (OPERATOR_OF | ALSO_READ).get(e[0].tag)
    if op is None:
        raise ValueError(f"no operator {e[0].tag}")
    x = Literal((e.text or "").strip(), op, (e[0].tail or "").strip())
    if x.kind != e.get("type"):
        raise ValueError(f"operator {e[0].tag} doesn't go with type {e.get('type')}")
    return x


def parse_rules(text: str) -> list[Rule]:
    """Rules of a rule-list file, in order; counts are read where they are written."""
    out = []
    for e in ET.fromstring(text).iter("rule"):
        heads = e.findall("att")
        if len(heads) != 1 or e.find("body") is None:
            raise ValueError("a rule has a body and one head")
        freq, pos = e.findtext("ex"), e.findtext("sup")
        r = Rule(tuple(_parse_literal(x) for x in e.find("body").findall("att")), _parse_literal(heads[0]))
        out.append(r.counted(int(pos), int(freq) - int(pos)) if freq and pos else r)
    return out


def induction_text(rules: list[Rule], data_file: str, made: datetime, seconds: float) -> str:
    """A rule set as text, with date, time taken and input."""
    took = f"{int(seconds // 3600)}:{int(seconds // 60 % 60)}:{int(seconds % 60)}"
    return f"[Classifier][Rules][{GROWN}]\n\n[{made:%d.%m.%y} {took}]\n[{data_file}]\n[" + "".join(words(r) + "\n\n" for r in rules) + "]\n"


def cluster_xml(model: ClusterModel) -> str:
    """Attributes, then for each cluster all values in the order of attributes and their values, and the number of members."""
    lines = ["<clustering>", "\t<ClusterAttr-list>"]
    for a in model.attributes:
        lines.append(
            f"\t\t<ClusterAttr> <AttrType>{a.kind}</AttrType> <weight>{a.weight!r}</weight> <name>{escape(a.name)}</name> "
            f"<dvalues>{escape(' '.join(a.values))}</dvalues> <mean>{a.mean!r}</mean> <dev>{a.dev!r}</dev></ClusterAttr>"
        )
    lines += ["\t</ClusterAttr-list>", "", "\t<Cluster-list>"]
    for c in model.clusters:
        values = []
        for a in model.attributes:
            here = c.items[a.name]
            values += [here.get(v, 0.0) for v in a.values] if a.kind == DISCRETE else [here]
        lines.append(f"\t\t<Cluster><values>{' '.join(repr(float(v)) for v in values)}</values><members>{c.members}</members></Cluster>")
    return "\n".join([*lines, "\t</Cluster-list>", "</clustering>"])


def parse_clusters(text: str) -> ClusterModel:
    """A clustering file; every field of an attribute must be there, and every cluster must have all values."""
    root = ET.fromstring(text)
    attrs = []
    for e in root.iter("ClusterAttr"):
        found = {k: e.findtext(k) for k in ("AttrType", "weight", "name", "dvalues", "mean", "dev")}
        if any(v is None for v in found.values()):
            raise ValueError(f"an attribute lacks {[k for k, v in found.items() if v is None]}")
        if found["AttrType"] not in (DISCRETE, CONTINUOUS):
            raise ValueError(f"no attribute type {found['AttrType']}")
        attrs.append(Attribute(found["name"].strip(), found["AttrType"], float(found["weight"]), tuple(found["dvalues"].split()), float(found["mean"]), float(found["dev"])))
    clusters = []
    for e in root.iter("Cluster"):
        values, at, items = [float(x) for x in (e.findtext("values") or "").split()], 0, {}
        for a in attrs:
            n = len(a.values) if a.kind == DISCRETE else 1
            here = values[at : at + n]
            if len(here) < n:
                raise ValueError("a cluster lacks values")
            items[a.name] = dict(zip(a.values, here)) if a.kind == DISCRETE else here[0]
            at += n
        if at != len(values):
            raise ValueError("a cluster has too many values")
        clusters.append(Centroid(items, int(e.findtext("members") or 0)))
    if not clusters:
        raise ValueError("there are no clusters")
    return ClusterModel(attrs, clusters)


def results_xml(result: Evaluation, target: str, rules_file: str, data_file: str, made: datetime) -> str:
    """The report of a classifier's test; the matrix has a row for each predicted class and one for the unclassified."""
    rows = "".join("\t\t<r>\n" + "".join(f"\t\t\t<d>{n}</d>\n" for n in row) + "\t\t</r>\n" for row in result.matrix)
    values = "".join(f"\t\t<target_val>{escape(v)}</target_val>\n" for v in result.values)
    return (
        f"<classifier_results>\n\t<date>{made:%d.%m.%Y}</date>\n\t<time>{made:%H:%M:%S}</time>\n\t<cl_type>{TESTED}</cl_type>\n"
        f"\t<cl_file>{escape(rules_file)}</cl_file>\n\t<data_file>{escape(data_file)}</data_file>\n\n\t<acc>{result.accuracy:f}</acc>\n"
        f"\t<all_ex>{result.rows}</all_ex>\n\t<all_corr>{result.correct}</all_corr>\n\t<all_wrong>{result.rows - result.correct}</all_wrong>\n\n"
        f"\t<target_attr>{escape(target)}</target_attr>\n\t<target_vals>\n{values}\t</target_vals>\n\n\t<matrix>\n{rows}\t</matrix>\n</classifier_results>\n"
    )
