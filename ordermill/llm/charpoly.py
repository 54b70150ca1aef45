"""Eigenvalues and eigenvectors of an integer matrix by its exact characteristic polynomial.

The matrix is symmetric without negative eigenvalues (a scatter matrix), so that its
polynomial has real roots only and Descartes' rule counts them exactly: the sign changes
of p(x + t) are the roots above t. All of it works on d * d numbers, whatever the number of
rows they were summed over.
"""

from __future__ import annotations

import sys
from decimal import Context, Decimal, localcontext
from math import gcd

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOT_BITS = 128  # width of a root's interval against the largest root


def largest_primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^31, falling."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for p in range(2, 256):
        small[p * p :: p] = False
    found: list[int] = []
    high = 1 << 31
    while len(found) < count:
        low = high - (1 << 20)
        window = np.ones(high - low, bool)
        for p in np.flatnonzero(small):
            window[int(-low % p) :: int(p)] = False
        found += [low + int(i) for i in np.flatnonzero(window)[::-1]]
        high = low
    return found[:count]


def coefficient_bits(trace: int, size: int) -> int:
    """Bits that hold every coefficient with its sign: all together are at most (1 + trace / size)^size."""
    return size * (trace // max(size, 1) + 2).bit_length() + 2


def polynomial_modulo(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``prime``, constant first, by reduction to Hessenberg form."""
    size, p = len(matrix), prime
    h = np.array(matrix % p, np.int64)
    for column in range(size - 2):
        below = np.flatnonzero(h[column + 1 :, column])
        if not len(below):
            continue
        pivot = column + 1 + int(below[0])
        if pivot != column + 1:
            h[[pivot, column + 1]] = h[[column + 1, pivot]]
            h[:, [pivot, column + 1]] = h[:, [column + 1, pivot]]
        factors = h[column + 2 :, column] * pow(int(h[column + 1, column]), -1, p) % p
        # Rows below lose a multiple of the pivot row; its column gains the same multiples of theirs.
        h[column + 2 :] = (h[column + 2 :] - factors[:, None] * h[column + 1] % p) % p
        h[:, column + 1] = (h[:, column + 1] + (h[:, column + 2 :] * factors % p).sum(axis=1)) % p
    found = np.zeros((size + 1, size + 1), np.int64)  # row k: the polynomial of the leading k * k block
    found[0, 0] = 1
    for k in range(1, size + 1):
        found[k, 1:] = found[k - 1, :-1]
        terms = np.zeros(k, np.int64)
        product = 1
        for i in range(k - 1, -1, -1):
            terms[i] = product * int(h[i, k - 1]) % p
            product = product * int(h[i, i - 1]) % p if i else 0
        found[k] = (found[k] - (found[:k] * terms[:, None] % p).sum(axis=0)) % p
    return found[size]


def combined(remainders: list[tuple[int, list[int]]]) -> list[int]:
    """The integers, of least absolute value, with the given remainders by prime."""
    modulus, values = 1, [0] * len(remainders[0][1])
    for prime, listed in remainders:
        inverse = pow(modulus % prime, -1, prime)
        values = [v + modulus * ((int(r) - v) * inverse % prime) for v, r in zip(values, listed)]
        modulus *= prime
    return [v - modulus if 2 * v > modulus else v for v in values]


def _sign_changes(values) -> int:
    signs = [v > 0 for v in values if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _roots_above(polynomial: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are greater than ``at`` (0 or more)."""
    if not at:
        return _sign_changes(polynomial)
    # p(at * y), then y + 1 for y, by additions alone; highest coefficient first.
    scaled, power = [], 1
    for value in polynomial:
        scaled.append(value * power)
        power *= at
    row = np.array(scaled[::-1], object)
    for step in range(len(row) - 1):
        row[: len(row) - step] = np.add.accumulate(row[: len(row) - step])
    return _sign_changes(row)


def _value(polynomial: list[int], at: int) -> int:
    total = 0
    for value in reversed(polynomial):
        total = total * at + value
    return total


def largest_roots(polynomial: list[int], count: int) -> list[tuple[Decimal, int]]:
    """(root, group) of the ``count`` largest roots, falling; equal roots share a group.

    Each root is isolated by counting, then halved to 2^-``ROOT_BITS`` of the largest root.
    Roots that lie closer together than that are taken as equal.
    """
    size = len(polynomial) - 1
    zeros = next(i for i, v in enumerate(polynomial) if v)
    positive = size - zeros
    reduced = polynomial[zeros:]
    found: list[tuple[Decimal, int]] = []
    if positive:
        trace = -polynomial[size - 1]
        largest = trace // size  # the largest root is at least the mean
        # One unit of the finer scale is 2^-scale.
        scale = max(ROOT_BITS - max(largest, 1).bit_length(), 0) + size.bit_length()
        fine = [v << (scale * (positive - i)) for i, v in enumerate(reduced)]
        known: dict[int, int] = {0: positive, (trace + 1) << scale: 0}

        def above(at: int) -> int:
            if at not in known:
                known[at] = _roots_above(fine, at)
            return known[at]

        for rank in range(1, min(count, positive) + 1):
            low = max(at for at, n in known.items() if n >= rank)
            high = min(at for at, n in known.items() if n < rank)
            while high - low > 1:
                if known[low] - known[high] == 1:
                    ends = _value(fine, low), _value(fine, high)
                    if ends[0] and ends[1]:
                        rising = ends[1] > 0
                        while high - low > 1:
                            middle = (low + high) // 2
                            value = _value(fine, middle)
                            if value and (value > 0) == rising:
                                known[middle] = rank - 1
                                high = middle
                            elif value:
                                known[middle] = rank
                                low = middle
                            else:
                                known[middle] = rank - 1
                                low = high = middle
                        break
                middle = (low + high) // 2
                if above(middle) >= rank:
                    low = middle
                else:
                    high = middle
            with localcontext(Context(prec=2000)):
                root = (Decimal(low) + Decimal(high)) / 2 / (1 << scale)
            group = found[-1][1] if found and found[-1][0] == root else len(found)
            found.append((root, group))
    return found + [(Decimal(0), positive)] * (min(count, size) - len(found))


def _start(size: int, number: int) -> np.ndarray:
    """A fixed start vector without structure."""
    golden = (5**0.5 - 1) / 2
    places = np.arange(1, size + 1) * (number + 1)
    return np.array([Decimal(float(v)) for v in 0.5 + (places * golden + places * places * 0.3819660112501051 * (number + 2)) % 1], object)


def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors that ``matrix`` - ``root`` takes (almost) to zero, by inverse iteration.

    One LU factorisation with row exchanges in decimal numbers of enough digits; the vectors
    are made orthogonal in each round, so that equal roots get as many vectors.
    """
    size = len(matrix)
    largest = max([abs(v) for row in matrix for v in row] + [1])
    digits = 2 * len(str(largest)) + 2 * ROOT_BITS // 3 + 40
    with localcontext(Context(prec=digits)):
        least = Decimal(largest) * Decimal(10) ** (-digits + 10)
        lu = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(size):
            lu[i, i] -= root
        order = list(range(size))
        for i in range(size):
            pivot = max(range(i, size), key=lambda r: abs(lu[r, i]))
            if pivot != i:
                lu[[i, pivot]] = lu[[pivot, i]]
                order[i], order[pivot] = order[pivot], order[i]
            if abs(lu[i, i]) < least:
                lu[i, i] = least
            if i + 1 < size:
                lu[i + 1 :, i] = lu[i + 1 :, i] / lu[i, i]
                lu[i + 1 :, i + 1 :] = lu[i + 1 :, i + 1 :] - np.multiply.outer(lu[i + 1 :, i], lu[i, i + 1 :])

        def solved(vector: np.ndarray) -> np.ndarray:
            x = vector[order]
            for i in range(1, size):
                x[i] = x[i] - (lu[i, :i] * x[:i]).sum()
            for i in range(size - 1, -1, -1):
                rest = (lu[i, i + 1 :] * x[i + 1 :]).sum() if i + 1 < size else 0
                x[i] = (x[i] - rest) / lu[i, i]
            return x

        vectors = [_start(size, number) for number in range(count)]
        for _ in range(3):
            done: list[np.ndarray] = []
            for vector in map(solved, vectors):
                vector = vector / max(abs(v) for v in vector)
                for _ in range(2):
                    for other in done:
                        vector = vector - (other * vector).sum() * other
                done.append(vector / (vector * vector).sum().sqrt())
            vectors = done
    return vectors


def content(matrix: list[list[int]]) -> int:
    """The greatest common divisor of all entries (1 if all are zero)."""
    return gcd(*(v for row in matrix for v in row)) or 1
