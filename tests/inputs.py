"""Call sets made by a rule, and what plain Python finds in them."""

from __future__ import annotations

import math
import random

HEADER = "##fileformat=VCFv4.2\n##contig=<ID=chr1,length=1000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def vcf(samples: str, *rows: str, head: str = HEADER) -> str:
    """Rows with blanks between their columns to VCF text."""
    return head + "\t".join(samples.split()) + "\n" + "".join("\t".join(r.split()) + "\n" for r in rows)


def random_calls(seed: int, n: int = 80, samples: int = 6) -> str:
    """Sites of two chromosomes with every form of call: missing, half missing, phased, haploid, without genotypes, many alleles."""
    rng = random.Random(seed)
    rows, pos = [], 10
    for i in range(n):
        if i == n // 2:
            pos = 5
        pos += rng.randint(1, 40)
        bases = ["A", *rng.sample(["C", "G", "T", "AT", "<DEL>"], rng.choice([0, 1, 1, 1, 1, 2, 4]))]
        fields = rng.choice([["GT"], ["GT", "DP"], ["DP", "GT"], ["GT", "GQ", "DP"], ["GQ", "DP", "GT"], ["DP"]])
        calm = rng.random() < 0.4  # whole diploid genotypes only

        def allele(whole=False, k=len(bases)):
            return "." if not whole and rng.random() < 0.2 else str(rng.randrange(k))

        def genotype(calm=calm, allele=allele):
            form = rng.random()
            if calm or form < 0.6:
                return allele(True) + rng.choice("/|") + allele(True)
            return allele() + rng.choice("/|") + allele() if form < 0.85 else allele()

        make = {"GT": genotype, "DP": lambda: rng.choice([".", str(rng.randint(0, 60))]), "GQ": lambda: rng.choice([".", str(rng.randint(0, 60))])}
        calls = [":".join(make[f]() for f in fields) for _ in range(samples)]
        qual = rng.choice([".", str(rng.randint(1, 99)), f"{rng.randint(1, 99)}.25"])
        rows.append(f"chr{1 + (i >= n // 2)} {pos} . A {','.join(bases[1:]) or '.'} {qual} PASS . {':'.join(fields)} {' '.join(calls)}")
    return vcf(" ".join(f"P{k}" for k in range(samples)), *rows)


class Site:
    """One line read by hand. A call is (alleles with None for missing, whether phased, depth or None, quality or None)."""

    def __init__(self, line: str):
        c = line.split("\t")
        self.chrom, self.pos, self.qual = c[0], int(c[1]), c[5]
        self.alleles = [c[3], *(c[4].split(",") if c[4] != "." else [])]
        fields, self.calls = c[8].split(":"), []
        for x in c[9:]:
            v = dict(zip(fields, x.split(":"), strict=True))
            gt = v.get("GT", "./.")
            number = lambda k: int(v[k]) if v.get(k, ".") != "." else None  # noqa: B023, E731
            self.calls.append(([None if a == "." else int(a) for a in gt.replace("|", "/").split("/")], "|" in gt, number("DP"), number("GQ")))
        self.called = [a for alleles, *_ in self.calls for a in alleles if a is not None]
        self.counts = [self.called.count(k) for k in range(len(self.alleles))]
        self.depths = [d for *_, d, _ in self.calls if d is not None]
        self.diploid = all(len(a) == 2 for a, *_ in self.calls)


def read(text: str) -> list[Site]:
    return [Site(x) for x in text.splitlines() if not x.startswith("#")]


def number(x: float) -> str:
    return "-nan" if math.isnan(x) else f"{x:.6g}"


def ratio(a: float, b: float) -> float:
    return a / b if b else math.nan


def brute(text: str, name: str) -> list[str]:
    """The lines of an output without filters, behind their chromosome (or sample), from the definitions."""
    sites, out = read(text), []
    if name in ("depth", "missing_indv"):
        for k in range(len(sites[0].calls)):
            own = [s.calls[k] for s in sites]
            depths = [d for *_, d, _ in own if d is not None]
            miss = sum(a[0] is None for a, *_ in own)
            out.append([str(len(depths)), number(ratio(sum(depths), len(depths)))] if name == "depth" else [str(len(own)), "0", str(miss), number(ratio(miss, len(own)))])
        return [" ".join(x) for x in out]
    for s in sites:
        n, d = len(s.called), s.depths
        # A phased call without its second allele counts as haploid here.
        slots = sum(len(a) - (phased and len(a) == 2 and a[1] is None) for a, phased, *_ in s.calls)
        miss = slots - n
        total, squares = sum(d) % 2**32, sum(x * x for x in d) % 2**32
        mean = ratio(total, len(d))
        mismatches = sum(c * (n - c) for c in s.counts)
        line = {
            "counts": lambda: [str(len(s.alleles)), str(n), *(f"{a}:{c}" for a, c in zip(s.alleles, s.counts, strict=True))],  # noqa: B023
            "freq": lambda: [str(len(s.alleles)), str(n), *(f"{a}:{number(ratio(c, n))}" for a, c in zip(s.alleles, s.counts, strict=True))],  # noqa: B023
            "missing_site": lambda: [str(slots), "0", str(miss), number(ratio(miss, slots))],  # noqa: B023
            "site_depth": lambda: [str(total), str(squares)],  # noqa: B023
            "site_mean_depth": lambda: [number(mean), number(ratio((squares / len(d) - mean * mean) * len(d), len(d) - 1) if d else math.nan)],  # noqa: B023
            "site_quality": lambda: [number(-1.0 if s.qual == "." else float(s.qual))],  # noqa: B023
            "site_pi": lambda: [number(ratio(mismatches, n * (n - 1)))] if s.diploid else None,  # noqa: B023
        }[name]()
        if line is not None:
            out.append(" ".join([str(s.pos), *line]))
    return out


def brute_fst(site: Site, populations: list[list[int]]) -> float:
    """Weir and Cockerham's estimate of 1984 over all alleles of a site; a sample may be in several populations."""
    r, num, den = len(populations), 0.0, 0.0
    for k in range(len(site.alleles)):
        own = [[site.calls[i][0] for i in p if None not in site.calls[i][0]] for p in populations]
        n = [len(x) for x in own]
        if min(n) == 0 or sum(n) <= r:
            continue
        p = [sum(a.count(k) for a in x) / (2 * m) for x, m in zip(own, n, strict=True)]
        h = [sum(a[0] != a[1] and k in a for a in x) / m for x, m in zip(own, n, strict=True)]
        bar = sum(n) / r
        nc = (r * bar - sum(m * m for m in n) / (r * bar)) / (r - 1)
        pb, hb = (sum(m * v for m, v in zip(n, x, strict=True)) / (r * bar) for x in (p, h))
        s2 = sum(m * (v - pb) ** 2 for m, v in zip(n, p, strict=True)) / ((r - 1) * bar)
        a = bar / nc * (s2 - (pb * (1 - pb) - (r - 1) / r * s2 - hb / 4) / (bar - 1))
        b = bar / (bar - 1) * (pb * (1 - pb) - (r - 1) / r * s2 - (2 * bar - 1) / (4 * bar) * hb)
        num, den = num + a, den + a + b + hb / 2
    return ratio(num, den)
