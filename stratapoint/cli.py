"""Command line: convert, info, merge, export, view."""

from __future__ import annotations

import argparse
import functools
import http.server
import os
import sys

from stratapoint.errors import InvalidTileset


def _convert(a: argparse.Namespace) -> None:
    from stratapoint.convert import MeshTiler, PointTiler, convert
    from stratapoint.session import local_session

    next_version = a.spec_version == "1.1"
    points = PointTiler(a.crs_in, a.crs_out, a.field, not a.no_colours, "glb" if next_version else "pnts", a.leaf_capacity, a.force_crs_in)
    convert(local_session(a.jobs or "*"), a.files, a.out, [points, MeshTiler("glb" if next_version else "b3dm")], a.overwrite)


def _info(a: argparse.Namespace) -> None:
    from stratapoint.codecs import sniff

    with open(a.file, "rb") as f:
        print(sniff.describe(f.read()))


def _merge(a: argparse.Namespace) -> None:
    from stratapoint.tileset import merge_files

    if os.path.exists(a.out) and not a.overwrite:
        raise FileExistsError(a.out)
    merge_files(a.files, a.out, a.seed)


def _export(a: argparse.Namespace) -> None:
    from stratapoint.export import export
    from stratapoint.session import local_session
    from stratapoint.sources import wkb

    spark = local_session(a.jobs or "*")
    if a.directory:
        geometries = wkb.directory(spark, a.directory)
    else:
        geometries = wkb.from_database(spark, a.url, a.table, a.geometry)
    export(geometries, a.out, overwrite=a.overwrite)


def find_tileset(path: str) -> tuple[str, str]:
    """(folder, file) of a tileset given as its file or folder."""
    if os.path.isdir(path):
        path = os.path.join(path, "tileset.json")
    if not os.path.isfile(path):
        raise InvalidTileset(f"no tileset at {path}")
    return os.path.dirname(os.path.abspath(path)), os.path.basename(path)


class Handler(http.server.SimpleHTTPRequestHandler):
    """Files of a folder, open to pages of other origins."""

    def end_headers(self) -> None:
        self.send_header("Access-Control-Allow-Origin", "*")
        super().end_headers()

    def log_message(self, *args: object) -> None:
        pass


def server(path: str, port: int = 8080) -> http.server.ThreadingHTTPServer:
    folder, _ = find_tileset(path)
    return http.server.ThreadingHTTPServer(("127.0.0.1", port), functools.partial(Handler, directory=folder))


def _view(a: argparse.Namespace) -> None:
    _, name = find_tileset(a.path)
    with server(a.path, a.port) as s:
        print(f"http://127.0.0.1:{s.server_address[1]}/{name}")
        s.serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratapoint")
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("convert", help="point and mesh files to a tileset")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", default="tiles")
    c.add_argument("--crs-in")
    c.add_argument("--crs-out")
    c.add_argument("--force-crs-in", action="store_true", help="take --crs-in whatever the files name")
    c.add_argument("--field", action="append", default=[], help="a further field to keep")
    c.add_argument("--no-colours", action="store_true")
    c.add_argument("--leaf-capacity", type=int, default=20_000)
    c.add_argument("--spec-version", choices=("1.0", "1.1"), default="1.0")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--jobs", type=int)
    c.set_defaults(run=_convert)
    c = sub.add_parser("info", help="what a content file holds")
    c.add_argument("file")
    c.set_defaults(run=_info)
    c = sub.add_parser("merge", help="one tileset of several")
    c.add_argument("files", nargs="+")
    c.add_argument("--out", required=True)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--overwrite", action="store_true")
    c.set_defaults(run=_merge)
    c = sub.add_parser("export", help="polygons to a quadtree of meshes")
    g = c.add_mutually_exclusive_group(required=True)
    g.add_argument("--directory")
    g.add_argument("--url", help="JDBC address")
    c.add_argument("--table")
    c.add_argument("--geometry", default="geom")
    c.add_argument("--out", default="tiles")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--jobs", type=int)
    c.set_defaults(run=_export)
    c = sub.add_parser("view", help="serve a tileset")
    c.add_argument("path")
    c.add_argument("--port", type=int, default=8080)
    c.set_defaults(run=_view)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
