"""The catalogue: documents of topologies, rules, morphisms and arrangements as JSON files, their identities, and their tables.

Documents are few and small; they are read as text, strictly parsed, and turned into tables for the operators.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.shapes import parse
from gneiss.operators import morphisms, relayout, rules
from gneiss.sources.safetensors import Refused, strict_json

TOPOLOGY = "topology string, component string, component_ord int, role string, key string, shape array<bigint>, island string, dtype string"
KINDS = {"components": "topology", "eligible": "rule", "base_dtype": "rule", "from": "morphism", "class": "arrangement"}


def kind_of(document: dict) -> str:
    """What a document is, by the members that only its kind has."""
    for member, kind in KINDS.items():
        if member in document:
            return kind
    raise Refused("kind")


def _truth(x: object) -> str:
    return "true" if x else "false"


def _dims(xs: list[int]) -> str:
    return "[" + ",".join(map(str, xs)) + "]"


def canonical(document: dict) -> str:
    """The text whose SHA-256 is the document's digest; it begins with the document's own format."""
    d, kind = document, kind_of(document)
    out = [d["format"], f"name={d['name']}", f"version={d['version']}"]
    if kind == "topology":
        out.append(f"dtype={d['dtype']}")
        for c in d["components"]:
            out.append(f"component name={c['name']} role={c['role']}")
            out += [f"tensor {k}={_dims(s)}" for k, s in sorted(c["tensors"].items(), key=lambda x: x[0].encode())]
            out += [f"island {k}={t}" for k, t in sorted((c.get("islands") or {}).items(), key=lambda x: x[0].encode())]
    elif kind == "rule":
        out += [f"declared_dtype={d.get('declared_dtype') or ''}", f"floor_sm={d.get('capability_floor_sm') or 0}", f"base={d['base_dtype']}", f"tolerant={_truth(d.get('reference_tolerant'))}", f"lossy={_truth(d.get('lossy'))}"]
        out += [f"convention {k}={v}" for k, v in sorted((d.get("conventions") or {}).items(), key=lambda x: x[0].encode())]
        out += [f"scope={r}" for r in d.get("scope_roles") or []]
        if e := d.get("eligible"):
            align = "[" + " ".join(map(str, e.get("dim_align") or [])) + "]"
            out.append(f"eligible dtypes={','.join(e.get('source_dtypes') or [])} rank={e.get('rank') or 0} rank>={e.get('rank_at_least') or 0} suffix={e.get('key_suffix') or ''} align={align} block={_truth(e.get('require_repeated_block_segment'))}")
            out.append(f"skip substrings={','.join(e.get('skip_module_substrings') or [])} exact={','.join(e.get('skip_module_exact') or [])}")
        out += [f"emit key={e['key']} dtype={e['dtype']} shape={','.join(e['shape'])} optional={_truth(e.get('optional'))}" for e in d.get("emissions") or []]
        out.append(f"inverse={d.get('inverse') or ''}")
    elif kind == "morphism":
        out += [f"from={d['from']}", f"to={d['to']}", f"tier={d['tier']}", f"invertible={_truth(d.get('invertible'))}"]
        out += [f"rekey prefix {r.get('from_prefix') or ''}->{r.get('to_prefix') or ''} key {r.get('from_key') or ''}->{r.get('to_key') or ''}" for r in d.get("rekey") or []]
        for s in d.get("seams") or []:
            out.append(f"seam target={s['target']} component={s.get('component') or ''} groups={s.get('groups') or 1}")
            out += [f"part role={p['role']} share={p['share']} key={p['key']}" for p in s["parts"]]
    else:
        out += [f"class={d['class']}", f"rank={d.get('rank') or 0}", f"candidate={_truth(d.get('candidate'))}"]
        out += [f"sub axis={s['axis']} extent={s['extent']}" for s in d.get("sub_axes") or []]
        out.append("perm=" + ",".join(map(str, d.get("permutation") or [])))
    return "\n".join(out) + "\n"


def digest(document: dict) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


def refusal(document: dict) -> str | None:
    """Why a document can't enter the catalogue; None if it can."""
    if document.get("digest") and document["digest"] != digest(document):
        return "digest"
    kind = kind_of(document)
    try:
        if kind == "rule":
            for e in document.get("emissions") or []:
                for f in e["shape"]:
                    parse(f)
        elif kind == "arrangement":
            return relayout.record_refusal(record(document))
        elif kind == "topology":
            names = [c["name"] for c in document["components"]]
            if len(set(names)) != len(names):
                return "duplicate-component"
    except ValueError:
        return "formula"
    return None


def record(document: dict) -> dict:
    """An arrangement's document as a record."""
    return {"rank": document.get("rank") or 0, "sub_axes": document.get("sub_axes") or [], "permutation": document.get("permutation") or [], "candidate": bool(document.get("candidate"))}


def load(spark: SparkSession, path: str) -> list[dict]:
    """The documents under a path, ordered by kind, name and version; refused ones raise with their file's name."""
    out = []
    for row in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).collect():
        try:
            document = strict_json(row["value"])
            why = refusal(document)
        except Refused as e:
            why = str(e)
        if why:
            raise Refused(f"{row['path']}: {why}")
        out.append(document)
    return sorted(out, key=lambda d: (kind_of(d), d["name"], d["version"]))


def topology_table(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """The tensors of topology documents."""
    rows = [
        (rules.handle(d), c["name"], n, c["role"], k, s, (c.get("islands") or {}).get(k), d["dtype"])
        for d in documents if kind_of(d) == "topology" for n, c in enumerate(d["components"]) for k, s in sorted(c["tensors"].items())
    ]
    return spark.createDataFrame(rows, TOPOLOGY)


def layouts(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """The header of every rule on every topology, as ``decide`` takes them, in the order of their handles."""
    tops = topology_table(spark, documents)
    order = {h: n for n, h in enumerate(sorted(rules.handle(d) for d in documents if kind_of(d) == "topology"))}
    every = sorted((d for d in documents if kind_of(d) == "rule"), key=rules.handle)
    out = None
    for k, rule in enumerate(every):
        made = rules.apply_rule(tops, rule)
        place = F.lit(None).cast("int")
        for h, n in order.items():
            place = F.when(F.col("topology") == h, n * len(every) + k).otherwise(place)
        hit = made.groupBy("topology").agg(F.max("transformed").alias("any"), F.max(F.col("reason").isNotNull()).alias("bad"))
        made = made.join(hit, "topology").where(~F.col("bad"))
        rows = made.select(F.concat_ws("+", "topology", "quant").alias("layout"), place.alias("layout_ord"), "component", "component_ord", "key", "dtypes", "shape", "optional", (~F.col("any") & F.lit(rules.transforms(rule))).alias("vacant"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(documents: list[dict]) -> list[tuple[str, str, str, int]]:
    """(from, to, name, tier) of the morphisms and, where they are invertible, their inverses."""
    out = []
    for d in documents:
        if kind_of(d) == "morphism":
            out.append((d["from"], d["to"], d["name"], d["tier"]))
            if d.get("invertible"):
                out.append((d["to"], d["from"], d["name"] + "-inverse", d["tier"]))
    return out


def unproved(spark: SparkSession, documents: list[dict]) -> list[str]:
    """Morphisms between known topologies that don't make their target of their source, or not back."""
    tops = topology_table(spark, documents)
    known = {rules.handle(d) for d in documents if kind_of(d) == "topology"}
    bad = []
    for d in documents:
        if kind_of(d) == "morphism" and {d["from"], d["to"]} <= known:
            a, b = tops.where(F.col("topology") == d["from"]), tops.where(F.col("topology") == d["to"])
            pairs = [(morphisms.apply_morphism(a, d), b)] + ([(morphisms.apply_morphism(b, morphisms.inverse(d)), a)] if d.get("invertible") else [])
            if any(not made.where("reason is not null").isEmpty() or not morphisms.difference(made, want).isEmpty() for made, want in pairs):
                bad.append(d["name"])
    return bad
