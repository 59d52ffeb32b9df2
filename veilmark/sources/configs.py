"""Settings from JSON and from profiles."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions.catalog import Pattern, Recogniser
from veilmark.operators.pipeline import Settings
from veilmark.operators.recognise import FINDERS, Context

ITEM = "array<struct<name: string, pattern: string, score: double, context: array<string>, language: string>>"


def parse_patterns(df: DataFrame, col: str) -> DataFrame:
    """A row a valid item of the JSON list in a column; what isn't a list, and items without name or pattern, are left out."""
    is_list = F.ltrim(F.col(col)).startswith("[")
    each = F.explode(F.from_json(F.when(is_list, F.col(col)), "array<string>"))
    item = F.from_json(F.col("item"), "struct<name: string, pattern: string, score: double, context: array<string>, language: string>", {"mode": "PERMISSIVE"})
    rows = df.withColumn("item", each).withColumn("i", item).filter("i.name IS NOT NULL AND i.pattern IS NOT NULL")
    return rows.select(*df.columns, "i.name", "i.pattern", F.coalesce("i.score", F.lit(0.7)).alias("score"), F.coalesce("i.context", F.array().cast("array<string>")).alias("context"), F.coalesce("i.language", F.lit("en")).alias("language"))


def custom_recognisers(items: list[dict]) -> tuple[Recogniser, ...]:
    return tuple(Recogniser(i["name"], "custom", (Pattern(i["name"], i["pattern"], float(i.get("score", 0.7))),), tuple(i.get("context", ()))) for i in items if isinstance(i, dict) and i.get("name") and i.get("pattern"))


@dataclass
class Profile:
    name: str
    description: str = ""
    base_domain: str = "general"
    extra_stoplist: list[str] = field(default_factory=list)
    custom_patterns: list[dict] = field(default_factory=list)
    min_score: float | None = None
    context: bool = True
    finders: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Profile:
        known = json.loads(text)
        if not known.get("name"):
            raise ValueError("a profile needs a name")
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__ and v is not None})

    def settings(self, file: dict | None = None) -> Settings:
        """Score: the profile's, else the environment's, else the file's, else 0.5."""
        least = self.min_score if self.min_score is not None else float(resolve("min_score", 0.5, file))
        return Settings(domain=self.base_domain, min_score=least, extra_stop=tuple(t.lower() for t in self.extra_stoplist), custom=custom_recognisers(self.custom_patterns), context=Context() if self.context else None, finders=tuple((n, FINDERS[n]) for n in self.finders))


def safe_name(name: str) -> str:
    """A name for a file: everything but letters, digits, underscores and hyphens becomes an underscore."""
    return re.sub(r"[^\w-]", "_", name)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def save_profile(folder: str, profile: Profile) -> str:
    """Writes a profile as JSON under its safe name; a profile of that name is replaced."""
    where, top = _place(folder)
    where.create_dir(top, recursive=True)
    path = f"{top}/{safe_name(profile.name)}.json"
    with where.open_output_stream(f"{path}.new") as f:
        f.write(json.dumps(asdict(profile), ensure_ascii=False, indent=1).encode())
    where.move(f"{path}.new", path)
    return path


def load_profile(folder: str, name: str) -> Profile:
    where, top = _place(folder)
    with where.open_input_stream(f"{top}/{safe_name(name)}.json") as f:
        return Profile.from_json(f.read().decode())


def list_profiles(folder: str) -> list[dict]:
    """Name, description, domain and sizes of each profile, by name; files that are none are left out."""
    where, top = _place(folder)
    out = []
    for info in where.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if info.path.endswith(".json"):
            try:
                with where.open_input_stream(info.path) as f:
                    p = Profile.from_json(f.read().decode())
            except (ValueError, TypeError):
                continue
            out.append({"name": p.name, "description": p.description, "base_domain": p.base_domain, "terms": len(p.extra_stoplist), "patterns": len(p.custom_patterns)})
    return sorted(out, key=lambda p: p["name"])


def delete_profile(folder: str, name: str) -> bool:
    """Whether there was one."""
    where, top = _place(folder)
    path = f"{top}/{safe_name(name)}.json"
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return False
    where.delete_file(path)
    return True


def resolve(name: str, default, file: dict | None = None):
    return os.environ.get(f"VEILMARK_{name.upper()}", (file or {}).get(name, default))
