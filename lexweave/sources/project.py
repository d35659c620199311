"""Project files on the driver: manifest, package archive, skeleton store."""

from __future__ import annotations

import json
import os
import posixpath
import re
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Written name; any one name at the top that ends so is read.
MANIFEST = "project.json"


class ProjectError(Exception):
    pass


@dataclass
class Manifest:
    name: str
    source_lang: str
    target_langs: list[str]
    tm: list[dict] = field(default_factory=list)
    glossaries: list[dict] = field(default_factory=list)
    mt: dict | None = None
    qa: dict = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    base_path: str = ""

    def path(self, p: str) -> str:
        """A path of the manifest: absolute ones as they are, others below the manifest's folder."""
        if p.startswith("/") or re.match(r"[A-Za-z]:[\\/]", p) or "://" in p:
            return p
        return posixpath.normpath(posixpath.join(self.base_path, p))


def with_environment(value, environ: dict[str, str] | None = None):
    """${NAME} in any string becomes the variable's value where it is set."""
    environ = os.environ if environ is None else environ
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: environ.get(m[1], m[0]), value)
    if isinstance(value, list):
        return [with_environment(x, environ) for x in value]
    if isinstance(value, dict):
        return {k: with_environment(v, environ) for k, v in value.items()}
    return value


def parse_manifest(source: str, base_path: str = "", environ: dict[str, str] | None = None, resolve: bool = True) -> Manifest:
    try:
        raw = json.loads(source)
    except json.JSONDecodeError as e:
        raise ProjectError(f"the manifest isn't JSON: {e}") from e
    for k in ("name", "sourceLang", "targetLangs"):
        if not raw.get(k):
            raise ProjectError(f"the manifest lacks {k}")
    if resolve:
        raw = with_environment(raw, environ)
    many = lambda k: [x if isinstance(x, dict) else {"path": x} for x in raw.get(k) or []]
    return Manifest(raw["name"], raw["sourceLang"], list(raw["targetLangs"]), many("tm"), many("glossaries"), raw.get("mt"), raw.get("qa") or {}, raw.get("filters") or {}, base_path)


def load_manifest(path: str) -> Manifest:
    if os.path.isdir(path):
        path = os.path.join(path, next((n for n in sorted(os.listdir(path)) if n.endswith(MANIFEST)), MANIFEST))
    try:
        with open(path, encoding="utf-8") as f:
            return parse_manifest(f.read(), os.path.dirname(os.path.abspath(path)))
    except FileNotFoundError as e:
        raise ProjectError(f"no manifest at {path}") from e


def write_package(to: str, manifest: str, parts: dict[str, bytes]) -> None:
    """An archive of the manifest and parts named source/..., tm/..., glossaries/..., xliff/...; memories and glossaries are stored as they are."""
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, manifest)
        for name, data in sorted(parts.items()):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_STORED if name.startswith(("tm/", "glossaries/")) else zipfile.ZIP_DEFLATED)


def open_package(path: str) -> tuple[Manifest, list[str]]:
    with zipfile.ZipFile(path) as z:
        name = next((n for n in z.namelist() if n.endswith(MANIFEST) and "/" not in n), None)
        if name is None:
            raise ProjectError(f"{path} holds no {MANIFEST}")
        return parse_manifest(z.read(name).decode(), resolve=False), [n for n in z.namelist() if n != name]


def extract_package(path: str, to: str) -> list[str]:
    """Unpacks; names that lead out of `to` are refused."""
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            if n.startswith("/") or ".." in n.split("/"):
                raise ProjectError(f"{n} leads out of the archive's folder")
        z.extractall(to)
        return z.namelist()


def store_skeletons(store: DataFrame | None, new: DataFrame) -> DataFrame:
    """(id, skeleton) after new ones have replaced those of the same id."""
    return new if store is None else store.join(new.select("id"), "id", "left_anti").unionByName(new)


def skeleton(store: DataFrame, id: str) -> DataFrame:
    return store.where(F.col("id") == id).select("skeleton")


def delete_skeletons(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")
