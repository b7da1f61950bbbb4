"""Run settings: TOML sections with defaults, path rules and the thresholds derived from them."""

from __future__ import annotations

import dataclasses
import datetime
import os
import tomllib
from pathlib import Path

CONFIG_PATTERNS = ("*_config.toml", "*Config.toml")  # file names that runs use, the first kind first
# Sections and keys of the run settings format, and the settings here that they mean.
FORMAT = {
    "data.adata_path": "data.path", "data.cluster_annot": "data.cluster", "spatial.radius": "kernel.radius", "spatial.weighted_ligand_scale_factor": "kernel.scale",
    "grn.network_data_dir": "data.network_dir", "grn.tf_ligand_cutoff": "kernel.tf_ligand_cutoff", "grn.top_lr_pairs_by_mean_expression": "kernel.max_lr_pairs",
    "lasso.l1_reg": "lasso.l1", "lasso.group_reg": "lasso.group", "lasso.n_iter": "lasso.iterations", "lasso.tol": "lasso.tolerance", "training.score_threshold": "lasso.least_r2",
    "perturbation.n_propagation": "perturbation.rounds", "perturbation.beta_scale_factor": "perturbation.beta_scale", "perturbation.beta_cap": "perturbation.beta_cap",
    "perturbation.ligand_grid_factor": "perturbation.grid_factor", "execution.output_dir": "data.output_dir",
}


@dataclasses.dataclass(frozen=True)
class Data:
    path: str = ""
    layer: str = "imputed_count"
    cluster: str = "cell_type_int"
    condition: str = ""
    network_dir: str = ""
    output_dir: str = ""


@dataclasses.dataclass(frozen=True)
class Lasso:
    l1: float = 1e-5
    group: float = 1e-5
    iterations: int = 500
    tolerance: float = 1e-5
    least_r2: float = 0.1


@dataclasses.dataclass(frozen=True)
class Kernel:
    radius: float = 100.0
    scale: float = 1.0
    grid_factor: float | None = None
    tf_ligand_cutoff: float = 0.2
    max_lr_pairs: int | None = None


@dataclasses.dataclass(frozen=True)
class Gate:
    permissiveness: float = 0.5
    moran_p: float = 0.05
    moran_p_strict: float = 0.01
    permutations: int = 199
    least_cells: int = 50

    def _scaled(self, p: float) -> float:
        return min(max(p * (0.3 + 1.4 * self.permissiveness), 0.0), 1.0)

    @property
    def p_max(self) -> float:
        return self._scaled(self.moran_p)

    @property
    def p_strict(self) -> float:
        return self._scaled(self.moran_p_strict)

    def least_r2(self, base: float) -> float:
        return max(0.0, base * (1.4 - 0.8 * self.permissiveness))


@dataclasses.dataclass(frozen=True)
class Perturbation:
    rounds: int = 4
    threshold: float = 1e-9
    beta_scale: float = 1.0
    beta_cap: float | None = None
    grid_factor: float | None = None

    def for_request(self, rounds: int | None) -> Perturbation:
        return self if rounds is None else dataclasses.replace(self, rounds=min(max(rounds, 1), 32))


@dataclasses.dataclass(frozen=True)
class Config:
    data: Data = Data()
    lasso: Lasso = Lasso()
    kernel: Kernel = Kernel()
    gate: Gate = Gate()
    perturbation: Perturbation = Perturbation()

    @classmethod
    def parse(cls, text: str) -> Config:
        """Every section and key may be missing; unknown ones are ignored. Names of the format (FORMAT) count where the
        name here isn't given."""
        found = tomllib.loads(text)
        for name, meant in FORMAT.items():
            (section, key), (own, field) = name.split("."), meant.split(".")
            if key in found.get(section, {}):
                found.setdefault(own, {}).setdefault(field, found[section][key])
        parts = {}
        for f in dataclasses.fields(cls):
            kind = type(getattr(cls(), f.name))
            own = found.get(f.name, {})
            parts[f.name] = kind(**{k.name: own[k.name] for k in dataclasses.fields(kind) if k.name in own})
        return cls(**parts)

    @classmethod
    def load(cls, folder: str = ".") -> Config:
        """The first readable settings file of the folder, else the defaults."""
        for path in (p for kind in CONFIG_PATTERNS for p in sorted(Path(folder).glob(kind))):
            try:
                return cls.parse(path.read_text())
            except (OSError, tomllib.TOMLDecodeError, TypeError):
                continue
        return cls()

    def to_toml(self) -> str:
        def text(v):
            return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)

        return "\n".join(f"[{name}]\n" + "".join(f"{k} = {text(v)}\n" for k, v in own.items() if v is not None) for name, own in dataclasses.asdict(self).items())


def write_once(path: str, text: str) -> bool:
    """Write a file unless it is there: the first writer wins."""
    try:
        with open(path, "x") as f:
            f.write(text)
        return True
    except FileExistsError:
        return False


def expanded(path: str) -> str:
    return os.path.expanduser(path)


def default_output_dir(data_path: str, today: datetime.date | None = None) -> str:
    return str(Path.cwd() / f"{Path(data_path).stem}_{(today or datetime.date.today()).isoformat()}")


def parse_gene_filter(text: str | None) -> list[str] | None:
    names = [g.strip() for g in (text or "").split(",") if g.strip()]
    return names or None


def parse_gene_set(text: str) -> set[str]:
    """Lines of names separated by commas; lines that start with # are notes."""
    return {g.strip() for line in text.splitlines() if not line.strip().startswith("#") for g in line.split(",") if g.strip()}


def network_file(species: str, folders: list[str]) -> str:
    """The first folder's network table; the error names every place tried."""
    tried = [str(Path(f) / f"{species}_network.parquet") for f in folders if f]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError("no network table; tried " + ", ".join(tried))
