"""Small numbered files that publish what a table consists of."""

import json
import uuid


class Manifest:
    """Versions of a small JSON value under ``path``/manifest; the newest counts and none is ever changed.

    One writer at a time; of two that publish the same version the second fails and may repeat.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def _files(self, path):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(path)
        return hadoop, folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def names(self, path):
        """Names of what lies in a folder, none if there is no folder."""
        _, files, folder = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def remove(self, path):
        """Removes a folder of data that no version in use names."""
        _, files, folder = self._files(path)
        files.delete(folder, True)

    def version(self):
        """The newest version, -1 if there is none."""
        names = self.names(f"{self.path}/manifest")
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def read(self):
        """The newest version and its value."""
        version = self.version()
        if version < 0:
            raise FileNotFoundError(f"no table in {self.path}")
        # one small file of one line; read by its own name, it never changes
        return version, json.loads(self.spark.read.text(f"{self.path}/manifest/{version:012d}.json").first().value)

    def publish(self, version, value):
        """Writes aside, then renames: a version is there whole or not at all."""
        hadoop, files, folder = self._files(f"{self.path}/manifest")
        aside, final = hadoop.Path(folder, f"_{uuid.uuid4().hex}"), hadoop.Path(folder, f"{version:012d}.json")
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if files.exists(final) or not files.rename(aside, final):
            raise RuntimeError(f"another writer has published version {version}")
