"""Exports for single machines: NumPy archives, Open3D clouds, an HTML page of a cloud."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.operators.topic import topic_view
from stratawave.schema import MESSAGE


def stacked(frame: pd.DataFrame) -> np.ndarray:
    """Payloads in one array; clouds that differ in their number of rows are padded with zeros, other differences are an error."""
    arrays = [np.asarray(d, float).reshape([int(x) for x in s]) for d, s in zip(frame["data"], frame["shape"])]
    if not arrays:
        return np.zeros((0,))
    if len({a.shape for a in arrays}) > 1:
        if len({a.shape[1:] for a in arrays}) > 1:
            raise ValueError("payloads differ in more than their first axis")
        n = max(a.shape[0] for a in arrays)
        arrays = [np.concatenate([a, np.zeros((n - a.shape[0], *a.shape[1:]))]) for a in arrays]
    return np.stack(arrays)


def save_topic_npz(df: DataFrame, topic: str, path: str, compressed: bool = True) -> str:
    """ts, data, id (texts) and metadata_json of one topic, without pickles; the topic must fit the driver."""
    frame = topic_view(df, topic)
    meta = {"topic": topic, "frame_id": next(iter(frame["frame_id"].dropna().unique()), None) if len(frame) else None, "source_uri": next(iter(frame["source_uri"].dropna().unique()), None) if len(frame) else None}
    save = np.savez_compressed if compressed else np.savez
    save(path, ts=frame["ts"].to_numpy(float), data=stacked(frame), id=np.array([n or "" for n in frame["name"]], dtype=str), metadata_json=np.array(json.dumps(meta)))
    return path


def load_topic_npz(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an archive."""
    with np.load(path, allow_pickle=False) as z:
        meta = json.loads(str(z["metadata_json"]))
        data, ts, names = z["data"], z["ts"], z["id"]
    rows = [(meta.get("topic"), i, float(t), str(n) or None, meta.get("frame_id"), meta.get("source_uri"), "float64", list(map(int, np.shape(d))), np.ravel(d).astype(float).tolist()) for i, (t, n, d) in enumerate(zip(ts, names, data))]
    return spark.createDataFrame(rows, MESSAGE)


def to_open3d_point_cloud(points: DataFrame, limit: int = 5_000_000):
    """An Open3D cloud of at most ``limit`` points, where Open3D is installed."""
    import open3d as o3d  # optional

    if points.limit(limit + 1).count() > limit:
        raise MemoryError(f"more than {limit} points")
    cloud = o3d.geometry.PointCloud()
    cloud.points = o3d.utility.Vector3dVector(points.select("x", "y", "z").toPandas().to_numpy(float))
    return cloud


def from_open3d_point_cloud(spark: SparkSession, cloud) -> DataFrame:
    """Points of an Open3D cloud, or of anything with ``points`` (N x 3)."""
    p = np.asarray(cloud.points, float)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(p)], "pid int, x double, y double, z double")


PAGE = """<!doctype html><meta charset="utf-8"><title>__TITLE__</title><style>body{margin:0;background:#111;color:#ccc;font:13px sans-serif}canvas{display:block}p{position:fixed;margin:8px}</style>
<p>__COUNT__ points; drag to turn, wheel to zoom</p><canvas id="c"></canvas><script>
const P=__POINTS__,c=document.getElementById("c"),g=c.getContext("2d");let a=0.6,b=0.5,z=1,d=null;
function draw(){c.width=innerWidth;c.height=innerHeight;const s=z*Math.min(c.width,c.height)/2.4;g.fillStyle="#9cf";
for(let i=0;i<P.length;i+=3){const x=P[i]*Math.cos(a)-P[i+1]*Math.sin(a),y=P[i]*Math.sin(a)+P[i+1]*Math.cos(a),v=P[i+2]*Math.cos(b)-y*Math.sin(b);g.fillRect(c.width/2+s*x,c.height/2-s*v,1.5,1.5)}}
onresize=draw;onmousedown=e=>d=[e.x,e.y];onmouseup=()=>d=null;onmousemove=e=>{if(d){a+=(e.x-d[0])/200;b+=(e.y-d[1])/200;d=[e.x,e.y];draw()}};onwheel=e=>{z*=Math.exp(-e.deltaY/800);draw()};draw()</script>"""


def write_html(points: DataFrame, path: str, title: str = "cloud", limit: int = 100_000) -> int:
    """A page that shows a cloud, thinned evenly by pid to at most ``limit`` points; the number of points shown."""
    n = points.count()
    step = max(1, -(-n // limit))
    frame = points.filter(F.pmod(F.col("pid").cast("long"), F.lit(step)) == 0).limit(limit).select("x", "y", "z").toPandas()
    p = frame.to_numpy(float)
    p = p[np.isfinite(p).all(axis=1)]
    if len(p):
        p = (p - p.mean(axis=0)) / (np.abs(p - p.mean(axis=0)).max() or 1.0)
    body = PAGE.replace("__TITLE__", title.replace("<", "&lt;")).replace("__COUNT__", str(len(p))).replace("__POINTS__", json.dumps([round(float(x), 5) for x in p.ravel()]))
    with open(path, "w", encoding="utf-8") as out:
        out.write(body)
    return len(p)
