"""A stand-in for the HDF5 library that driver and Python workers import: files are pickled nested mappings."""

import os
import pickle
import sys

MODULE = '''
import pickle
import numpy as np


class Dataset:
    def __init__(self, value, name):
        self.value, self.name, self.attrs, self.chunks = np.asarray(value), name, {}, None
        self.shape, self.ndim, self.dtype = self.value.shape, self.value.ndim, self.value.dtype
        if self.ndim > 1:
            self.chunks = tuple(min(n, 16) for n in self.shape)

    def __getitem__(self, key):
        return self.value[key]


class Group:
    def __init__(self, held, name):
        self.held, self.name, self.attrs = held, name, {}

    def _find(self, path):
        at = self.held
        for part in path.strip("/").split("/"):
            at = at[part]
        name = self.name.rstrip("/") + "/" + path
        return Group(at, name) if isinstance(at, dict) else Dataset(at, name)

    def __contains__(self, path):
        return self.get(path) is not None

    def get(self, path):
        try:
            return self._find(path)
        except (KeyError, TypeError, IndexError):
            return None

    __getitem__ = _find

    def items(self):
        return [(k, self._find(k)) for k in self.held]

    def visititems(self, f, top=""):
        for k, v in self.items():
            f(top + k, v)
            if isinstance(v, Group):
                v.visititems(f, top + k + "/")


class File(Group):
    def __init__(self, path, mode="r"):
        try:
            with open(path, "rb") as f:
                super().__init__(pickle.load(f), "/")
        except pickle.UnpicklingError as e:
            raise OSError(path) from e

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return None
'''


def install(spark, folder, monkeypatch):
    """Make the module importable here and by workers that start from now on."""
    (folder / "h5py.py").write_text(MODULE)
    monkeypatch.syspath_prepend(str(folder))
    monkeypatch.delitem(sys.modules, "h5py", raising=False)
    env = spark.sparkContext.environment
    monkeypatch.setitem(env, "PYTHONPATH", os.pathsep.join([str(folder), env.get("PYTHONPATH", "")]))


def save(path, tree):
    path.write_bytes(pickle.dumps(tree))
    return str(path)
