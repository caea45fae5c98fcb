"""External programs: aligners, maskers, parsimony searches. None is bundled; each is given as a command."""

from __future__ import annotations

import contextlib
import itertools
import os
import random
import shlex
import shutil
import subprocess
import tempfile
import threading
import time

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed command templates of aligners that write SAM.
ALIGNERS = {
    "bwa": ("bwa mem -t {cores} {ref} {fq}", "bwa index {ref}"),
    "bwa-mem2": ("bwa-mem2 mem -t {cores} {ref} {fq}", "bwa-mem2 index {ref}"),
    "minimap2": ("minimap2 -ax sr -t {cores} {ref} {fq}", "true"),
    "bbmap": ("bbmap.sh ref={ref} path={refdir} in={fq} out=stdout.sam threads={cores} ordered=t", "bbmap.sh ref={ref} path={refdir}"),
}
#: Fixed command lines of the maskers, in order; {jobs}: RepeatMasker's search uses four threads a job.
MASKERS = {
    "windowmasker": (
        "windowmasker -in {fasta} -infmt fasta -mk_counts -out {out}.counts",
        "windowmasker -in {fasta} -infmt fasta -ustat {out}.counts -dust {dust} -outfmt interval -out {out}.intervals",
    ),
    "repeatmasker": ("RepeatMasker -pa {jobs} -dir {folder} {species} {fasta}",),
}

#: What tells a program's version, fixed command lines.
VERSIONS = {"minimap2": "minimap2 --version", "bbmap": "bbmap.sh --version", "windowmasker": "windowmasker -version", "repeatmasker": "RepeatMasker -v"}


def aligner_command(name: str = "bwa", template: str | None = None) -> str:
    """The command of a known aligner, or a template with {fq}, {cores} and {ref} or {refdir}."""
    if template is None:
        if name not in ALIGNERS:
            raise ValueError(f"unknown aligner {name}; known: {', '.join(sorted(ALIGNERS))}")
        return ALIGNERS[name][0]
    missing = [k for k in ("{fq}", "{cores}") if k not in template]
    if missing or ("{ref}" not in template and "{refdir}" not in template):
        raise ValueError(f"the command needs {', '.join(missing) or '{ref} or {refdir}'}")
    return template


def masker(name: str) -> str:
    if name not in MASKERS:
        raise ValueError(f"unknown masker {name}; known: {', '.join(MASKERS)}")
    return name


def mask_genome(fasta: str, folder: str, program: str = "windowmasker", species: str | None = None, dust: bool = True, cores: int = 1, cache: bool = True) -> str:
    """The file of intervals that a masker, run on the driver, makes of a FASTA file. One that is there is not made
    again; one that is half made never is there, as the masker's own file gets its name last."""
    out = os.path.join(folder, os.path.basename(fasta))
    made = f"{out}.{'intervals' if masker(program) == 'windowmasker' else 'out'}"
    kept = f"{made}.done"
    if cache and os.path.exists(kept):
        return kept
    os.makedirs(folder, exist_ok=True)
    own = {"fasta": shlex.quote(fasta), "out": shlex.quote(out), "folder": shlex.quote(folder)}
    for step in MASKERS[program]:
        run(step.format(**own, dust=str(dust).lower(), jobs=max(1, cores // 4), species=f"-species {shlex.quote(species)}" if species else ""))
    if not os.path.exists(made):
        raise RuntimeError(f"{program} left no {made}")
    os.replace(made, kept)
    return kept


def index(reference: str, command: str, cores: int = 1, force: bool = False) -> bool:
    """Prepares a FASTA file, in a folder that all executors see, for an aligner. The command may hold {ref}, {refdir}
    and {cores}. It is noted beside the file when it is through, so that an index of another command, or one that broke
    off, is made anew. Tells whether it ran."""
    note = f"{reference}.indexed-by"
    if not force and os.path.exists(note):
        with open(note) as f:
            if f.read() == command:
                return False
    with contextlib.suppress(FileNotFoundError):
        os.remove(note)
    run(command.format(ref=shlex.quote(reference), refdir=shlex.quote(os.path.dirname(os.path.abspath(reference))), cores=cores))
    with open(note, "w") as f:
        f.write(command)
    return True


def run(command: str, tries: int = 1, cap: float = 300.0) -> str:
    """Output of a command; failures are tried again after growing, jittered waits."""
    for i in range(tries):
        done = subprocess.run(shlex.split(command), capture_output=True, text=True)
        if done.returncode == 0:
            return done.stdout
        if i + 1 < tries:
            time.sleep(min(cap, 2**i) * (0.5 + random.random()))
    raise RuntimeError(f"{command}: exit {done.returncode}: {done.stderr[-500:]}")


def available(program: str) -> bool:
    return shutil.which(program) is not None


def aligner(command: str, ref: str = "", refdir: str = "", cores: int = 1) -> str:
    """A template's command that reads FASTQ from its standard input."""
    return command.format(fq="-", ref=ref, refdir=refdir, cores=cores)


def align(fragments: DataFrame, command: str, ref: str = "", refdir: str = "", cores: int = 1) -> DataFrame:
    """SAM lines (value) of fragments (chrom, start, end, seq) piped through an aligner, whose template may hold {fq},
    {ref}, {refdir} and {cores}. A partition is one process; FASTQ goes in while SAM comes out, so neither is held as a
    whole. Names carry the order, so the output's order doesn't matter. A process that fails fails its task, with the
    end of what it complained of."""
    words = shlex.split(aligner(command, ref, refdir, cores))

    def pipe(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryFile() as said:
            done = subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=said, text=True)
            broken: list[BaseException] = []

            def feed():
                try:
                    with done.stdin as to:
                        for batch in itertools.chain([first], batches):
                            for chrom, start, end, seq in zip(*(c.to_pylist() for c in batch.columns)):
                                to.write(f"@{chrom}_{start}_{end}\n{seq}\n+\n{'I' * len(seq)}\n")
                except BaseException as e:  # told below, with the exit code
                    broken.append(e)

            feeder = threading.Thread(target=feed, daemon=True)
            feeder.start()
            lines: list[str] = []
            for line in done.stdout:
                if line.strip() and not line.startswith("@"):
                    lines.append(line.rstrip("\n"))
                if len(lines) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                    lines = []
            feeder.join()
            if done.wait() or broken:
                said.seek(0)
                raise RuntimeError(f"{words[0]}: exit {done.returncode}: {said.read()[-500:].decode(errors='replace')} {broken[:1]}")
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return fragments.select("chrom", "start", "end", "seq").mapInArrow(pipe, "value string")


def versions(commands: dict[str, str]) -> dict[str, str]:
    """The first line that each program says about its version; what isn't there is left out."""
    out = {}
    for name, command in commands.items():
        if available(shlex.split(command)[0]):
            done = subprocess.run(shlex.split(command), capture_output=True, text=True)
            out[name] = ((done.stdout or done.stderr).strip().splitlines() or [""])[0]
    return out


def parsimony_search(infile: str, command: str, folder: str) -> tuple[str, str]:
    """outfile and outtree of a program that reads ``infile`` in its folder, answers given by default."""
    with open(f"{folder}/infile", "w") as f:
        f.write(infile)
    done = subprocess.run(shlex.split(command), cwd=folder, input="Y\n", capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"{command}: exit {done.returncode}: {done.stderr[-500:]}")
    return tuple(open(f"{folder}/{name}").read() for name in ("outfile", "outtree"))
