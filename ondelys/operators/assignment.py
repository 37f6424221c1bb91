"""One-to-one assignment at the least total cost."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import Executor, ThreadPoolExecutor

import numpy as np
from pyspark.sql import SparkSession


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row (rows <= columns): shortest augmenting paths with potentials."""
    rows, cols = cost.shape
    if rows > cols:
        raise ValueError("there are more rows than columns")
    row_price, col_price, owner = np.zeros(rows + 1), np.zeros(cols + 1), np.full(cols + 1, -1)
    for r in range(rows):
        owner[cols] = r
        at, far, came, seen = cols, np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            now = owner[at]
            slack = cost[now] - row_price[now] - col_price[:cols]
            better = ~seen[:cols] & (slack < far)
            far[better], came[better] = slack[better], at
            to = int(np.where(seen[:cols], np.inf, far).argmin())
            step = far[to]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            far[~seen[:cols]] -= step
            at = to
        while at != cols:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.full(rows, -1)
    taken = np.flatnonzero(owner[:cols] >= 0)
    out[owner[taken]] = taken
    return out


#: Nearest cells listed for a point; the others are looked at where a path may need them.
LISTED = 48

#: The paths of `assign_cells`, one after the other and so no work for NumPy; compiled in the driver by the compiler that Spark's own plans use.
PATHS = """
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;
import java.util.concurrent.atomic.AtomicInteger;

public class GridPaths implements java.util.function.Function, Runnable {
    // Equal points are one kind with one list; the last kind is that of rows without costs.
    int n, kinds, across, down, cells, rows, listed;
    double[] px, py, price, cost, bound, base;
    int[] near, kind;
    final AtomicInteger next = new AtomicInteger();
    volatile Throwable failed;

    // A heap of (key, code): a cell, or -1 - row for the bound of its kind's list.
    double[] keys = new double[1024];
    int[] codes = new int[1024];
    int held;

    void push(double key, int code) {
        if (held == keys.length) {
            keys = Arrays.copyOf(keys, 2 * held);
            codes = Arrays.copyOf(codes, 2 * held);
        }
        int at = held++;
        while (at > 0) {
            int up = (at - 1) >> 1;
            if (keys[up] <= key) break;
            keys[at] = keys[up];
            codes[at] = codes[up];
            at = up;
        }
        keys[at] = key;
        codes[at] = code;
    }

    void pop() {
        double key = keys[--held];
        int code = codes[held], at = 0;
        while (true) {
            int below = 2 * at + 1;
            if (below >= held) break;
            if (below + 1 < held && keys[below + 1] < keys[below]) below++;
            if (keys[below] >= key) break;
            keys[at] = keys[below];
            codes[at] = codes[below];
            at = below;
        }
        keys[at] = key;
        codes[at] = code;
    }

    double squared(int of, int cell) {
        double dx = px[of] - cell % across, dy = py[of] - cell / across;
        return dx * dx + dy * dy;
    }

    // Lists the cells of least cost less price; `all` has one number a cell, top and which one a listed cell and one more.
    void list(int of, double[] all, double[] top, int[] which) {
        double least = Double.POSITIVE_INFINITY;
        int best = 0;
        for (int r = 0, c = 0; r < down; r++) {
            double dy = (py[of] - r) * (py[of] - r);
            for (int a = 0; a < across; a++, c++) {
                double dx = px[of] - a, v = dx * dx + dy - price[c];
                all[c] = v;
                if (v < least) {
                    least = v;
                    best = c;
                }
            }
        }
        int size = listed < cells ? listed + 1 : listed, got = 0;
        // A window around the least first, so few others come below the largest.
        int half = 4, c0 = Math.max(0, best % across - half), c1 = Math.min(across, best % across + half + 1);
        int r0 = Math.max(0, best / across - half), r1 = Math.min(down, best / across + half + 1);
        for (int r = r0; r < r1; r++)
            for (int a = c0; a < c1; a++) got = keep(all[r * across + a], r * across + a, top, which, got, size);
        for (int r = 0, c = 0; r < down; r++) {
            boolean inside = r >= r0 && r < r1;
            for (int a = 0; a < across; a++, c++)
                if ((got < size || all[c] < top[0]) && !(inside && a >= c0 && a < c1)) got = keep(all[c], c, top, which, got, size);
        }
        int from = 0;
        if (listed < cells) {
            bound[of] = top[0];
            from = 1;
        }
        for (int k = 0; k < listed; k++) {
            near[of * listed + k] = which[from + k];
            cost[of * listed + k] = squared(of, which[from + k]);
        }
    }

    // A heap with the largest first.
    int keep(double v, int cell, double[] top, int[] which, int got, int size) {
        int at = got;
        if (got < size) {
            got++;
            while (at > 0 && top[(at - 1) >> 1] < v) {
                top[at] = top[(at - 1) >> 1];
                which[at] = which[(at - 1) >> 1];
                at = (at - 1) >> 1;
            }
        } else {
            if (v >= top[0]) return got;
            at = 0;
            while (true) {
                int below = 2 * at + 1;
                if (below >= size) break;
                if (below + 1 < size && top[below + 1] > top[below]) below++;
                if (top[below] <= v) break;
                top[at] = top[below];
                which[at] = which[below];
                at = below;
            }
        }
        top[at] = v;
        which[at] = cell;
        return got;
    }

    public void run() {
        try {
            double[] all = new double[cells], top = new double[listed + 1];
            int[] which = new int[listed + 1];
            for (int at = next.getAndAdd(64); at < kinds; at = next.getAndAdd(64))
                for (int of = at; of < Math.min(kinds, at + 64); of++) list(of, all, top, which);
        } catch (Throwable e) {
            failed = e;
        }
    }

    int[] owner, taken, came, seen, done, path, which, renewed, scanned;
    double[] far, length_of, all, top;
    double best;
    int turn;

    void relax(int cell, double d, int row) {
        if (d < best && done[cell] != turn && (seen[cell] != turn || d < far[cell])) {
            seen[cell] = turn;
            far[cell] = d;
            came[cell] = row;
            push(d, cell);
            if (owner[cell] < 0) best = d;
        }
    }

    void whole(int row, double length) {
        int of = kind[row];
        for (int c = 0; c < cells; c++) {
            double d = length + Math.max((of < kinds ? squared(of, c) : 0.0) - price[c] - base[row], 0.0);
            if (d < best) relax(c, d, row);
        }
    }

    void some(int row, double length) {
        int of = kind[row];
        for (int k = of * listed; k < (of + 1) * listed; k++) relax(near[k], length + Math.max(cost[k] - price[near[k]] - base[row], 0.0), row);
        if (bound[of] < Double.POSITIVE_INFINITY) push(Math.max(length, length + bound[of] - base[row]), -1 - row);
    }

    // The next cell that a shortest path reaches; its length is far[cell].
    int nearest() {
        int cell = -1;
        double d = 0;
        boolean found = false;
        while (!found) {
            d = keys[0];
            cell = codes[0];
            pop();
            if (cell >= 0) found = done[cell] != turn && d <= far[cell];
            else if (d < best) renew(-1 - cell);
        }
        return cell;
    }

    void renew(int row) {
        int of = kind[row];
        if (renewed[of] == turn) whole(row, length_of[of]);
        else {
            renewed[of] = turn;
            list(of, all, top, which);
            some(row, length_of[of]);
        }
    }

    void assign(int start) {
        int steps = 0, row = start, cell = -1, left = -1, of = -1;
        double length = 0, less = 0;
        turn++;
        held = 0;
        best = Double.POSITIVE_INFINITY;
        while (row >= 0) {
            of = kind[row];
            // Of equal rows those met later have no shorter path.
            if (scanned[of] != turn) {
                scanned[of] = turn;
                length_of[of] = length;
                if (of < kinds) some(row, length);
                else whole(row, length);
            }
            cell = nearest();
            length = far[cell];
            done[cell] = turn;
            row = owner[cell];
            if (row >= 0) path[steps++] = cell;
        }
        for (int k = 0; k < steps; k++) {
            less = length - far[path[k]];
            price[path[k]] -= less;
            base[owner[path[k]]] += less;
        }
        base[start] += length;
        while (row != start) {
            row = came[cell];
            owner[cell] = row;
            left = taken[row];
            taken[row] = cell;
            cell = left;
        }
    }

    public Object apply(Object given) {
        ByteBuffer in = ByteBuffer.wrap((byte[]) given).order(ByteOrder.LITTLE_ENDIAN);
        n = in.getInt();
        kinds = in.getInt();
        across = in.getInt();
        down = in.getInt();
        rows = in.getInt();
        listed = in.getInt();
        cells = across * down;
        kind = new int[rows];
        px = new double[kinds];
        py = new double[kinds];
        price = new double[cells];
        Arrays.fill(kind, kinds);
        for (int i = 0; i < n; i++) kind[i] = in.getInt();
        for (int i = 0; i < kinds; i++) {
            px[i] = in.getDouble();
            py[i] = in.getDouble();
        }
        double highest = Double.NEGATIVE_INFINITY;
        for (int c = 0; c < cells; c++) {
            price[c] = in.getDouble();
            highest = Math.max(highest, price[c]);
        }
        near = new int[kinds * listed];
        cost = new double[kinds * listed];
        bound = new double[kinds];
        Arrays.fill(bound, Double.POSITIVE_INFINITY);
        Thread[] others = new Thread[Math.min(8, Runtime.getRuntime().availableProcessors()) - 1];
        for (int i = 0; i < others.length; i++) {
            others[i] = new Thread(this);
            others[i].start();
        }
        run();
        try {
            for (int i = 0; i < others.length; i++) others[i].join();
        } catch (InterruptedException e) {
            throw new RuntimeException(e);
        }
        if (failed != null) throw new RuntimeException(failed);

        base = new double[rows];
        owner = new int[cells];
        taken = new int[rows];
        Arrays.fill(owner, -1);
        Arrays.fill(taken, -1);
        Arrays.fill(base, -highest);
        for (int row = 0; row < n; row++) {
            int first = -1, of = kind[row];
            base[row] = Double.POSITIVE_INFINITY;
            for (int k = of * listed; k < (of + 1) * listed; k++) {
                double v = cost[k] - price[near[k]];
                if (v < base[row]) {
                    base[row] = v;
                    first = near[k];
                }
            }
            if (owner[first] < 0) {
                owner[first] = row;
                taken[row] = first;
            }
        }

        all = new double[cells];
        top = new double[listed + 1];
        which = new int[listed + 1];
        length_of = new double[kinds + 1];
        renewed = new int[kinds + 1];
        scanned = new int[kinds + 1];
        far = new double[cells];
        came = new int[cells];
        seen = new int[cells];
        done = new int[cells];
        path = new int[cells];
        for (int start = 0; start < rows; start++)
            if (taken[start] < 0) assign(start);
        ByteBuffer out = ByteBuffer.allocate(4 * n).order(ByteOrder.LITTLE_ENDIAN);
        for (int i = 0; i < n; i++) out.putInt(taken[i]);
        return out.array();
    }
}
"""


def _smoothed(x: np.ndarray, width: float, run: Executor) -> np.ndarray:
    """At each cell of (down, across), -width * log(sum over cells of exp((x - squared distance) / width))."""
    for _ in range(2):
        n = x.shape[1]
        far = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2

        def smooth(line: np.ndarray, far: np.ndarray = far) -> np.ndarray:
            each = line[None] - far
            each /= width
            top = each.max(axis=1)
            each -= top[:, None]
            return width * (top + np.log(np.exp(each, out=each).sum(axis=1)))

        x = np.ascontiguousarray(np.stack(list(run.map(smooth, x))).T)
    return -x


def _prices(points: np.ndarray, across: int, down: int) -> np.ndarray:
    """Prices of the cells near those of the best assignment: entropic transport of the points' histogram, the width halved step by step."""
    at = np.clip(np.rint(points).astype(int), 0, [across - 1, down - 1])
    mass = np.zeros((down, across))
    np.add.at(mass, (at[:, 1], at[:, 0]), 1.0)
    log_mass = np.where(mass > 0, np.log(np.maximum(mass, 1)), -1e6)
    log_cell = np.log(len(points) / mass.size)
    price, width = np.zeros_like(mass), max(across, down) ** 2 / 8
    with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as run:
        while True:
            for _ in range(6):
                own = _smoothed(price + width * log_cell, width, run)
                price = _smoothed(own + width * log_mass, width, run)
            if width <= 0.5:
                return price.ravel()
            width = max(0.5, width / 2)


def assign_cells(spark: SparkSession, points: np.ndarray, across: int, down: int, listed: int = LISTED) -> np.ndarray:
    """Cell (row by row) of each point at the least total squared distance; the costs are never held whole.

    Shortest augmenting paths as in `assign`, from prices that are nearly right
    already.  A point's nearest cells are listed, and a bound for all others:
    prices only fall, so a path shorter than the bound needs no other cell, and
    where it isn't the point is listed anew, then looks at every cell.
    """
    n, cells = len(points), across * down
    if n > cells:
        raise ValueError("there are more points than cells")
    # Few cells too many are filled by rows without costs; of many, a free one is never far and prices start at 0.
    full = cells - n <= n // 8
    price = _prices(points, across, down) if full else np.zeros(cells)
    places, kind = np.unique(points, axis=0, return_inverse=True)
    head = np.array([n, len(places), across, down, cells if full else n, min(listed, cells)], "<i4")
    gateway = spark.sparkContext._gateway
    # Py4J keeps methods by the name of their class, so every call's class has its own.
    name, compiler = f"GridPaths{uuid.uuid4().hex}", gateway.jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(PATHS.replace("GridPaths", name))
    paths = compiler.getClassLoader().loadClass(name).getConstructor(gateway.new_array(gateway.jvm.java.lang.Class, 0)).newInstance(gateway.new_array(gateway.jvm.java.lang.Object, 0))
    return np.frombuffer(paths.apply(b"".join([head.tobytes(), kind.astype("<i4").tobytes(), places.astype("<f8").tobytes(), price.astype("<f8").tobytes()])), "<i4")
