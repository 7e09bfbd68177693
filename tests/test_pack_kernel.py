import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.operators import pack_kernel as kernel
from batchloom.schemas import PackLimits
from model import DEMO_JOB, SMALL_JOB, one_by_one, seeded_tokens, sizes


@st.composite
def jobs(draw):
    safe = draw(st.integers(3, 60))
    hard = safe + draw(st.integers(0, 40))
    limits = PackLimits(safe, hard, draw(st.sampled_from([1, 2, 3, 5, 9, 500])), draw(st.booleans()))
    top = draw(st.sampled_from([1, 3, min(40, hard)]))
    tokens = draw(st.lists(st.integers(1, min(top, hard)), min_size=1, max_size=80))
    return tokens, limits


@settings(max_examples=400, deadline=None)
@given(jobs(), st.lists(st.integers(1, 20), min_size=1, max_size=20))
def test_pieces_give_what_one_by_one_gives(job, pieces):
    tokens, limits = job
    packer, got, begin, turn = kernel.Packer(limits), [], 0, 0
    while begin < len(tokens):
        part = np.array(tokens[begin : begin + pieces[turn % len(pieces)]])
        seq, pos = packer.assign(part, np.zeros(len(part), dtype=bool))
        got += list(zip(seq.tolist(), pos.tolist()))
        begin, turn = begin + len(part), turn + 1
    assert got == one_by_one(tokens, limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(jobs(), min_size=1, max_size=5))
def test_numbering_restarts_with_each_run(job_list):
    limits = job_list[0][1]
    runs = [[min(t, limits.hard) for t in tokens] for tokens, _ in job_list]
    breaks = np.concatenate([[True] + [False] * (len(run) - 1) for run in runs])
    seq, pos = kernel.Packer(limits).assign(np.concatenate(runs), breaks)
    expected = [placed for run in runs for placed in one_by_one(run, limits)]
    assert list(zip(seq.tolist(), pos.tolist())) == expected


@settings(max_examples=200, deadline=None)
@given(jobs())
def test_outcomes_for_every_first_start(job):
    tokens, limits = job
    entries = min(limits.max_items, len(tokens))
    begun, open_tokens, open_items = kernel.outcomes(np.array(tokens), entries, limits)
    for e in range(entries):
        batches = sizes(tokens[e:], limits)
        n, total = batches[-1]
        full = total >= limits.safe or n >= limits.max_items
        expected = (len(batches), 0, 0) if full else (len(batches), total, n)
        assert (begun[e], open_tokens[e], open_items[e]) == expected


@pytest.mark.parametrize(
    "tokens, limits, expected",
    [
        ([80_000] * 3, PackLimits(), [240_000]),
        ([80_000] * 3, PackLimits(allow_overflow=False), [160_000, 80_000]),
        ([10_000] * 5, PackLimits(), [50_000]),
        ([80_000] * 10, PackLimits(), [240_000] * 3 + [80_000]),
        ([230_000, 1], PackLimits(), [230_000, 1]),
    ],
)
def test_known_batches(tokens, limits, expected):
    assert [total for _, total in sizes(tokens, limits)] == expected
    seq, _ = kernel.Packer(limits).assign(np.array(tokens), np.zeros(len(tokens), dtype=bool))
    assert np.bincount(seq, weights=tokens)[1:].tolist() == expected


def test_seeded_jobs():
    demo = sizes(seeded_tokens(*DEMO_JOB), PackLimits())
    assert len(demo) == 31 and sum(total for _, total in demo) == 6_779_991
    assert all(200_000 <= total <= 240_000 for _, total in demo[:-1])
    small = sizes(seeded_tokens(*SMALL_JOB), PackLimits())
    assert small == [(324, 224_674), (328, 224_800), (48, 33_190)]


def test_limits_are_checked():
    for bad in ((10, 9, 1), (0, 9, 1), (10, 10, 0)):
        with pytest.raises(ValueError):
            PackLimits(*bad)


@settings(max_examples=400, deadline=None)
@given(
    st.lists(jobs(), min_size=1, max_size=4),
    st.lists(st.sampled_from([1, 2, 5, 20, 50]), min_size=1, max_size=20),
    st.lists(st.integers(1, 4), min_size=1, max_size=10),
)
def test_reports_lead_from_piece_to_piece(job_list, lengths, block_lengths):
    """Pieces entered as the reports of those before say give what one by one gives; and reports
    combined in blocks say the same as the single ones."""
    limits = job_list[0][1]
    rows = [(j, min(t, limits.hard)) for j, (ts, _) in enumerate(job_list) for t in ts]
    expected = [
        place
        for ts, _ in job_list
        for place in one_by_one([min(t, limits.hard) for t in ts], limits)
    ]
    pieces, begin = [], 0
    while begin < len(rows):
        pieces.append(rows[begin : begin + lengths[len(pieces) % len(lengths)]])
        begin += len(pieces[-1])

    def arrays(piece):
        ids, tokens = np.array(piece).T
        return tokens, np.concatenate(([False], ids[1:] != ids[:-1]))

    reports = [
        kernel.Report.of(str(p[0][0]), str(p[-1][0]), *arrays(p), limits) for p in pieces
    ]

    def states(some):
        job, state = None, (0, 0, 0)
        for report in some:
            if report.first != job:
                state = (0, 0, 0)
            yield tuple(int(v) for v in state)
            state = report.after(job, *(np.int64(v) for v in state), limits)
            job = report.last

    entries, got = list(states(reports)), []
    for piece, entry in zip(pieces, entries):
        seq, pos = kernel.Packer(limits, *entry).assign(*arrays(piece))
        got += zip(seq.tolist(), pos.tolist())
    assert got == expected

    blocks, starts, begin = [], [], 0
    while begin < len(reports):
        members = reports[begin : begin + block_lengths[len(blocks) % len(block_lengths)]]
        combined = members[0]
        for report in members[1:]:
            combined = combined.then(report, limits)
        blocks.append(combined)
        starts.append(begin)
        begin += len(members)
    assert list(states(blocks)) == [entries[at] for at in starts]
