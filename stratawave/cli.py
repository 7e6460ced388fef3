"""Command line: topics, info, export, ingest, viewer, demo."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("stratawave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def flagship(messages, cloud_topic: str = "/points", pose_topic: str = "/odom"):
    """Points of all scans in the world's frame, each scan placed by the latest pose seen before it."""
    from stratawave.functions import quaternion as q
    from stratawave.functions import vectors as v
    from stratawave.operators.align import align_backward
    from stratawave.operators.points import explode_points, valid_point_cloud_points

    clouds, poses = messages.filter(F.col("topic") == cloud_topic), messages.filter(F.col("topic") == pose_topic)
    placed = align_backward(clouds.select("topic", "seq", "ts"), poses.select("ts", "seq", F.col("data").alias("pose"))).filter("valid")
    a, b = valid_point_cloud_points(explode_points(clouds)).alias("a"), placed.alias("b")
    joined = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.seq") == F.col("b.seq")))
    turned = q.rotate_vectors_by_quaternion([F.col(f"a.{c}") for c in "xyz"], v.unpack("b.pose", 4, 8))
    world = v.add(turned, v.unpack("b.pose", 3))
    return joined.select("a.topic", "a.seq", "a.pid", *(w.alias(c) for w, c in zip(world, "xyz")))


def run(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run a command and print, and give back, its lines."""
    from stratawave.operators.summary import describe_dataset, format_describe
    from stratawave.sources import export, sources
    from stratawave.sources.store import Store

    parser = argparse.ArgumentParser(prog="stratawave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("topics", "info", "export", "ingest", "viewer"):
        p = commands.add_parser(name)
        p.add_argument("source")
        if name in ("export", "viewer"):
            p.add_argument("topic")
        if name in ("export", "ingest", "viewer"):
            p.add_argument("output")
        if name == "export":
            p.add_argument("--limit", type=int)
            p.add_argument("--stride", type=int, default=1)
    commands.add_parser("demo").add_argument("output")
    args = parser.parse_args(arguments)
    spark = spark or session()
    lines: list[str] = []
    if args.command == "demo":
        from stratawave.operators.trajectory import odometry_to_trajectory, write_tum_trajectory
        from stratawave.operators.windows import trajectory_speed

        messages = sources.synthetic(spark)
        lines += [r.line for r in format_describe(describe_dataset(messages)).orderBy("topic").collect()]
        odom = odometry_to_trajectory(messages.filter("topic = '/odom'"))
        lines.append("mean speed %.3f m/s" % trajectory_speed(odom).agg(F.avg("speed")).first()[0])
        write_tum_trajectory(odom, f"{args.output}/odom_tum")
        lines.append(f"{export.write_html(flagship(messages), f'{args.output}/cloud.html', 'stitched scans')} points written")
    else:
        messages = sources.data_source(spark, args.source)
        if args.command == "topics":
            lines += [r.topic for r in messages.select("topic").distinct().orderBy("topic").collect()]
        elif args.command == "info":
            lines += [r.line for r in format_describe(describe_dataset(messages)).orderBy("topic").collect()]
        elif args.command == "export":
            chosen = messages.filter((F.col("topic") == args.topic) & (F.col("seq") % args.stride == 0))
            chosen = chosen if args.limit is None else chosen.filter(F.col("seq") < args.limit * args.stride)
            lines.append(export.save_topic_npz(chosen, args.topic, args.output))
        elif args.command == "ingest":
            store = Store(spark, args.output)
            store.append(messages, closed=True)
            lines += [f"{r.topic} {r['count']}" for r in store.manifest().orderBy("topic").collect()]
        elif args.command == "viewer":
            from stratawave.operators.points import explode_points

            lines.append(f"{export.write_html(explode_points(messages.filter(F.col('topic') == args.topic)), args.output, args.topic)} points written")
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    run()
