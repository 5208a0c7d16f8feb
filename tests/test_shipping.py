"""Kernels must reach executors that do not have this package installed."""

import subprocess
import sys

from pyspark import cloudpickle

from monthloom.models import smoothing


def test_kernels_travel_by_value(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(smoothing.project))
    code = "import pickle, numpy as np; f = pickle.load(open('f.pkl', 'rb')); print(f(np.array(1.0), np.array(2.0), None, 2).tolist())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/usr/local/bin"})
    assert run.stdout.strip() == "[3.0, 5.0]", run.stderr
