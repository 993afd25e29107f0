"""From frames to relabelled frames: Markov model and cores, committor and rates, pathways, relabelling.

Every step is a Parquet table under its stage's folder. Its manifest holds the
stage's settings and the hashes of the steps it reads, so a step is reused only
while nothing before it has changed, and a run that was stopped goes on where
it was.

    python -m lagwell.plans.workflow --input frames.parquet --output run --config config.yaml --step all
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.functions.committor import Loss, Net
from lagwell.operators import expansion as X
from lagwell.operators import lag as L
from lagwell.operators import model as M
from lagwell.operators import paths as Q
from lagwell.operators import relabel as R
from lagwell.operators.frames import number_rows
from lagwell.plans import pathways as P
from lagwell.plans import stages as S
from lagwell.sinks.writers import content_hash, manifest_hash, save_training, stage_table
from lagwell.sources.readers import config as read_config

log = logging.getLogger(__name__)

#: What each step of stages 1 to 3 reads, besides the labelled frames of stage 0 (``core``).
NEEDS = {
    "1.train": (),
    "1.infer": ("1.train",),
    "1.rate_constant": ("1.infer",),
    "2.select": ("1.rate_constant",),
    "2.shoot": ("1.train", "1.infer", "2.select"),
    "2.cluster": ("2.shoot",),
    "2.voronoi": ("1.infer", "2.cluster"),
    "3.diagnostics": ("1.infer",),
    "3.relabel_entropy": ("1.infer",),
    "3.relabel_gini": ("1.infer",),
    "3.rate_merge": ("1.infer", "1.rate_constant"),
}


def net_table(spark: SparkSession, net: Net) -> DataFrame:
    """A network as rows ``(layer, part, rows, cols, numbers, head, activation, dropout)``; parts w and b, with normalised layers also scale, shift, mean and variance."""
    groups = (("w", "b"), net.layers), (("scale", "shift"), net.norms), (("mean", "variance"), net.running)
    rows = [(k, part, a.shape[0], a.shape[1] if a.ndim > 1 else 0, a.ravel().tolist(), net.head, net.activation, float(net.dropout)) for names, pairs in groups for k, pair in enumerate(pairs) for part, a in zip(names, pair, strict=True)]
    return spark.createDataFrame(rows, "layer int, part string, rows int, cols int, numbers array<double>, head string, activation string, dropout double")


def read_net(table: DataFrame) -> Net:
    rows = {(r["layer"], r["part"]): r for r in table.collect()}
    pairs = lambda a, b: [tuple(np.array(rows[k, p]["numbers"]) for p in (a, b)) for k in range(sum(p == a for _, p in rows))]
    layers = [(w.reshape(rows[k, "w"]["rows"], -1), b) for k, (w, b) in enumerate(pairs("w", "b"))]
    first, norms = rows[0, "w"], pairs("scale", "shift")
    return Net((layers[0][0].shape[0], *(b.size for _, b in layers)), first["head"], first["activation"], layers=layers, batch_norm=bool(norms), dropout=first["dropout"], norms=norms, running=pairs("mean", "variance"))


def _settings(kind: type, cfg: dict, prefix: str = "") -> object:
    """A dataclass from the keys of a section that are its fields; lists become tuples."""
    known = {f.name: cfg[prefix + f.name] for f in fields(kind) if prefix + f.name in cfg}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


@dataclass
class Workflow:
    """One folder of stages over one table of frames (``traj_id``, ``frame``, ``weight``, ``x``; ``row_id`` is made where absent)."""

    spark: SparkSession
    frames: DataFrame
    folder: str
    config: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)

    def section(self, stage: str) -> dict:
        names = (stage, *S.STAGES[stage])
        return next((self.config[n] for n in names if isinstance(self.config.get(n), dict)), {})

    def labelled(self) -> DataFrame:
        """Stage 0 up to the cores, or the frames as they come where they have a ``state`` already."""
        if "core" not in self.tables:
            if "state" in self.frames.columns:
                source, self.hashes["core"] = self.frames, content_hash(self.frames)
            else:
                cfg = self.section("0")
                keyed = self.frames if "row_id" in self.frames.columns else number_rows(self.frames, ["traj_id", "frame"])
                source = S.run_msm(keyed, cfg, f"{self.folder}/0", "core", bool(cfg.get("force", False)))["core"]
                self.hashes["core"] = content_hash(source)
            dense = number_rows(source.select("traj_id", "frame", "weight", F.col("x").cast("array<double>").alias("x"), F.col("state").cast("int").alias("state")), ["traj_id", "frame"])
            self.tables["core"] = stage_table(lambda: dense, self.spark, f"{self.folder}/frames", {"step": "frames", "upstream": self.hashes["core"]})
            self.hashes["core"] = manifest_hash({"step": "frames", "upstream": self.hashes["core"]})
        return self.tables["core"]

    def n_states(self) -> int:
        found = self.labelled().agg(F.max("state")).first()[0]
        if found is None or found < 1:
            raise ValueError("two labelled states are needed")
        return found + 1

    def table(self, name: str, force: bool = False) -> DataFrame:
        """The table of a step, with those it needs before it; only the named step is forced."""
        if name not in NEEDS:
            raise ValueError(f"unknown step {name!r}; known: {', '.join(NEEDS)}")
        if name not in self.tables or force:
            self.labelled()
            for need in NEEDS[name]:
                self.table(need)
            stage, step = name.split(".")
            cfg = self.section(stage)
            manifest = {"step": name, "settings": {k: v for k, v in cfg.items() if k not in ("force", "substep")}, "upstream": {n: self.hashes[n] for n in ("core", *NEEDS[name])}}
            maker: Callable[[dict], DataFrame] = getattr(self, f"_{step}")
            log.info("step %s", name)
            self.tables[name] = stage_table(lambda: maker(cfg), self.spark, f"{self.folder}/{stage}/{step}", manifest, force)
            self.hashes[name] = manifest_hash(manifest)
        return self.tables[name]

    def run(self, stage: str = "all", substep: str | None = None) -> dict[str, DataFrame]:
        """The steps of a stage, a single one, or all stages in order; unknown names fail before anything runs."""
        if stage == "all" and substep is not None:
            raise ValueError("a substep belongs to one stage")
        chosen = list(S.STAGES) if stage == "all" else [S.canonical_stage(stage)]
        steps = {s: S.substeps(s, substep or self.section(s).get("substep")) for s in chosen}
        out: dict[str, DataFrame] = {}
        for s in chosen:
            force = bool(self.section(s).get("force", False))
            if s == "0":
                last = max(steps[s], key=S.SUBSTEPS["0"].index)
                keyed = self.frames if "row_id" in self.frames.columns else number_rows(self.frames, ["traj_id", "frame"])
                found = {} if "state" in self.frames.columns else S.run_msm(keyed, self.section("0"), f"{self.folder}/0", last, force)
                out |= {f"0.{k}": v for k, v in found.items()}
                continue
            out |= {f"{s}.{k}": self.table(f"{s}.{k}", force) for k in steps[s]}
        return out

    # ---- stage 1: committor and rates

    def _pairs(self, cfg: dict) -> DataFrame:
        pairs = L.positive_pairs(L.positional_pairs(self.labelled(), cfg.get("lag", 1), ["x", "state", "weight"]))
        named = pairs.select("row_id", "x", "x_tau", F.col("state").alias("label"), F.col("state_tau").alias("label_tau"), "weight")
        return L.labelled_filter(named, cfg.get("require_labeled", "none"), "label", "label_tau")

    def _train(self, cfg: dict) -> DataFrame:
        n, d = self.n_states(), len(self.labelled().select("x").first()[0])
        net = Net((d, *cfg.get("hidden", (32, 32)), n), cfg.get("head", "softmax"), cfg.get("activation", "elu"), batch_norm=bool(cfg.get("batch_norm", False)), dropout=float(cfg.get("dropout", 0.0)))
        asked = {k: cfg[k] for k in ("epochs", "rate", "patience", "validation", "seed", "batches", "schedule", "final_boundary", "decay_epochs") if k in cfg}
        fitted, history = M.train(self._pairs(cfg), net, _settings(Loss, {"flux": 0.0, **cfg}), **asked)
        found = net_table(self.spark, fitted)
        save_training(self.spark, f"{self.folder}/1/training", found, history)
        return found

    def _infer(self, cfg: dict) -> DataFrame:
        return M.infer(self.labelled(), read_net(self.tables["1.train"]))

    def _rate_constant(self, cfg: dict) -> DataFrame:
        found = S.rate_matrices(self.tables["1.infer"], self.n_states(), cfg.get("lag", 1), eps=cfg.get("eps", 0.02), blocks=cfg.get("blocks", 10), edge_filter=cfg.get("edge_filter"))
        return self.spark.createDataFrame([(r["i"], r["j"], *(None if r[k] is None else float(r[k]) for k in ("k", "k_direct", "mfpt", "p_jump", "std"))) for r in found["table"]], "i int, j int, k double, k_direct double, mfpt double, p_jump double, std double")

    def _matrix(self, name: str) -> np.ndarray:
        n = self.n_states()
        out = np.zeros((n, n))
        for r in self.tables["1.rate_constant"].collect():
            out[r["i"], r["j"]] = np.nan if r[name] is None else r[name]
        return out

    # ---- stage 2: pathways

    def _select(self, cfg: dict) -> DataFrame:
        chosen = P.state_pairs(np.nan_to_num(self._matrix("p_jump")), cfg.get("min_jump", 0.0))
        return self.spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(chosen)], "rank int, i int, j int")

    def _chosen(self) -> list[tuple[int, int]]:
        return [(r["i"], r["j"]) for r in self.tables["2.select"].orderBy("rank").collect()]

    def _shoot(self, cfg: dict) -> DataFrame:
        net, how = read_net(self.tables["1.train"]), _settings(Q.Shooting, cfg)
        out = self.spark.createDataFrame([], "i int, j int, path_id long, image_id int, x array<double>, weight double, cluster int")
        for i, j in self._chosen():
            found = P.gradient_paths(self.tables["1.infer"], net, i, j, threshold=cfg.get("channel_threshold", 0.1), starts=cfg.get("starts", 100), n_images=cfg.get("n_images", 50), cutoff=cfg.get("cluster_cutoff", 0.25), least_share=cfg.get("least_share", 0.0), periods=cfg.get("periods"), seed=cfg.get("seed", 0), shooting=how)
            out = out.unionByName(found["paths"].join(F.broadcast(found["members"]), "path_id").select(F.lit(i).alias("i"), F.lit(j).alias("j"), "path_id", "image_id", "x", "weight", "cluster"))
        return out

    def _cluster(self, cfg: dict) -> DataFrame:
        return Q.center_path(self.tables["2.shoot"], ("i", "j", "cluster"))

    def _voronoi(self, cfg: dict) -> DataFrame:
        asked = _settings(X.Expansion, {"rounds": 5, **cfg})
        rows = []
        centers = self.tables["2.cluster"].orderBy("i", "j", "cluster", "image_id").collect()
        for i, j in sorted({(r["i"], r["j"]) for r in centers}):
            paths: dict[int, list] = {}
            for r in centers:
                if (r["i"], r["j"]) == (i, j):
                    paths.setdefault(r["cluster"], []).append(r["x"])
            start = {k: np.array(v) for k, v in paths.items()}
            periods = cfg.get("periods") or [0.0] * len(centers[0]["x"])
            done = X.expand(self.tables["1.infer"], start, asked, X.Box(tuple(map(float, periods))))
            shared = {n for group in done[-1].shared.values() for n in group}
            rows += [(i, j, p, k, x.tolist(), (p, k) in shared) for p, images in done[-1].moved.items() for k, x in enumerate(images)]
        return self.spark.createDataFrame(rows, "i int, j int, path_id int, image_id int, x array<double>, shared boolean")

    # ---- stage 3: diagnostics and relabelling

    def _proposal(self, cfg: dict, score: str) -> DataFrame:
        s = R.settings({"relabel": cfg, **cfg})
        known = {f.name for f in fields(R.Settings)} - {"score", "lags", "extra"}
        s = R.Settings(**{**s.__dict__, **{k: v for k, v in cfg.items() if k in known}, "score": score})
        return R.propose(self.tables["1.infer"], s)[0].select("row_id", "traj_id", "frame", "old_state", "state")

    def _diagnostics(self, cfg: dict) -> DataFrame:
        return P.diagnose_labels(self.tables["1.infer"], list(cfg.get("lags", (1, 2, 5))))["states"]

    def _relabel_entropy(self, cfg: dict) -> DataFrame:
        return self._proposal(cfg, "entropy")

    def _relabel_gini(self, cfg: dict) -> DataFrame:
        return self._proposal(cfg, "gini")

    def _rate_merge(self, cfg: dict) -> DataFrame:
        merged, _ = R.merge_by_rates(self.tables["1.infer"].withColumn("old_state", F.col("state")), self._matrix("p_jump"), self._matrix("mfpt"), cfg.get("merge_probability", 0.95), cfg.get("merge_time", 100.0), bool(cfg.get("bidirectional", False)))
        return merged.select("row_id", "traj_id", "frame", "old_state", "state")


def main(arguments: list[str] | None = None) -> dict[str, DataFrame]:
    parser = argparse.ArgumentParser(description="From frames to relabelled frames")
    parser.add_argument("--input", required=True, help="frames as Parquet, any path that Spark reads")
    parser.add_argument("--output", required=True, help="the folder of the run")
    parser.add_argument("--config", help="YAML with a section for each stage")
    parser.add_argument("--step", default="all", help="0/msm, 1/committor, 2/gradpath, 3/relabel or all")
    parser.add_argument("--substep", help="one step of that stage")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("workflow").getOrCreate()
    done = Workflow(spark, spark.read.parquet(given.input), given.output.rstrip("/"), read_config(given.config) if given.config else {}).run(given.step, given.substep)
    for name, table in done.items():
        log.info("%s: %d rows", name, table.count())
    return done


if __name__ == "__main__":
    main()
