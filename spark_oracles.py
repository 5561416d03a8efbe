"""DuckDB SQL that computes each registered query independently."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from corpusprep.config import EOS


@dataclass(frozen=True)
class Parameters:
    accepted: tuple[str, ...] = tuple(f"src{i}" for i in range(10))
    seed: int = 7
    max_stories: int = 50
    feed_batch: int = 256
    block_stories: int = 70
    vocab_size: int = 300
    context: int = 512
    workers: int = 3
    row_limit: int = 100
    positions: tuple[int, ...] = (0, 3, 41, 200)
    epochs: int = 2
    batch: int = 128
    accumulate: int = 8
    max_steps: int = 2
    many_steps: int = 9
    train_ratio: float = 0.99
    fine_ratio: float = 0.912345678


Q = Parameters()

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_WORDS = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def word_list(text: str) -> str:
    spaced = f"CASE WHEN {text} LIKE ' %' THEN {text} ELSE ' ' || {text} END"
    return f"regexp_extract_all({spaced}, '{_WORDS}')"


def byte_ids(text: str) -> str:
    """Token ids of the bytes of a text: printable bytes first, then the others."""
    number = "('0x' || h)::BIGINT"
    return f"""[CASE WHEN {number} <= 32 THEN {number} + 189
      WHEN {number} <= 126 THEN {number} - 32
      WHEN {number} <= 160 THEN {number} + 95
      WHEN {number} <= 172 THEN {number} - 66
      WHEN {number} = 173 THEN 256
      ELSE {number} - 67 END FOR h IN regexp_extract_all(hex(encode({text})), '..')]"""


def split_of(text: str, ratio: float) -> str:
    draw = f"('0x' || substr(md5('{Q.seed}:' || {text}), 1, 15))::BIGINT"
    return f"CASE WHEN {draw} >= {int(Fraction(ratio) * 16**15)} THEN 'valid' ELSE 'train' END"


_ACCEPTED = "(" + ", ".join(f"'{s}'" for s in Q.accepted) + ")"
_LINES = (
    "[x FOR x IN [" + stripped("l")
    + r" FOR l IN regexp_split_to_array(text, '\r\n|\r|\n')] IF x <> '']"
)
_RECORD = rf"array_to_string({_LINES}, chr(10)) || chr(10) || '{EOS}'"


def stories(where: str = "true", name: str = "stories") -> str:
    return f"""{name} AS (
  SELECT min(doc_id) AS story_id, story AS text,
         {split_of("story", Q.train_ratio)} AS split
  FROM (SELECT doc_id, {stripped("text")} AS story FROM documents WHERE {where})
  GROUP BY story)"""


def records(where: str = "true") -> str:
    return f"""{stories(where)},
records AS (SELECT story_id, split, {_RECORD} AS text FROM stories)"""


_TRAIN_WORDS = f"""word_counts AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest({word_list("text")}) AS word FROM records WHERE split = 'train')
  GROUP BY word)"""

# Token i is the character 4096 + i, so that a merge is a replacement.
_ROUNDS = Q.vocab_size - 257


def training(where: str = "true") -> str:
    """Words of all texts through every merge round; ``pair`` is the round's merge."""
    symbols = f"array_to_string([chr((4096 + i)::INT) FOR i IN {byte_ids('word')}], '')"
    return f"""{records(where)},
{_TRAIN_WORDS},
segments AS (
  SELECT story_id, split, substr(text, 1, length(text) - {len(EOS)}) AS text FROM records),
story_words AS (
  SELECT story_id, split, generate_subscripts(w, 1) AS pos, unnest(w) AS word
  FROM (SELECT story_id, split, {word_list("text")} AS w FROM segments)),
all_words AS (
  SELECT word, coalesce(max(freq), 0) AS freq
  FROM (SELECT word, freq FROM word_counts UNION ALL SELECT DISTINCT word, 0 FROM story_words)
  GROUP BY word),
rounds AS MATERIALIZED (
  SELECT 0 AS step, word, freq, {symbols} AS symbols, '' AS pair, 0::HUGEINT AS pair_freq
  FROM all_words
  UNION ALL
  SELECT r.step + 1, r.word, r.freq, replace(r.symbols, best.pair, chr(4353 + r.step)),
         best.pair, best.n
  FROM rounds r, (
    SELECT pair, sum(freq) AS n
    FROM (SELECT freq, unnest([substr(symbols, i, 2) FOR i IN range(1, length(symbols))]) AS pair
          FROM rounds)
    GROUP BY pair ORDER BY n DESC, pair LIMIT 1) best
  WHERE r.step < {_ROUNDS}),
merges AS MATERIALIZED (
  SELECT DISTINCT step - 1 AS rank, ord(substr(pair, 1, 1)) - 4096 AS left_id,
         ord(substr(pair, 2, 1)) - 4096 AS right_id, 4352 + step - 4096 AS new_id,
         pair_freq AS freq
  FROM rounds WHERE step > 0),
encoded AS (
  SELECT s.story_id, s.split,
         [ord(x) - 4096 FOR x IN string_split(string_agg(r.symbols, '' ORDER BY s.pos), '')]
           || [0] AS ids
  FROM story_words s JOIN rounds r ON r.word = s.word AND r.step = {_ROUNDS}
  GROUP BY s.story_id, s.split)"""


def numbers(items: str) -> str:
    return f"array_to_string({items}, ',')"


_BYTE_IDS = f"""encoded AS (
  SELECT doc_id AS story_id, {byte_ids("CASE WHEN text LIKE ' %' THEN text ELSE ' ' || text END")}
         AS ids
  FROM documents)"""


def chunked(by: str = "") -> str:
    return f"""chunks AS (
  SELECT {by}story_id, p::INT AS chunk_no, ids[p * {Q.context} + 1 : (p + 1) * {Q.context}] AS ids
  FROM (SELECT {by}story_id, ids,
               unnest(range(0, greatest(1, (len(ids) + {Q.context - 1}) // {Q.context}))) AS p
        FROM encoded))"""


def ordered(seed: int = Q.seed, by: str = "") -> str:
    over = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    return f"""ordered AS (
  SELECT *, row_number() OVER ({over}ORDER BY md5('{seed}:' || story_id || ':' || chunk_no),
                               story_id, chunk_no) - 1 AS idx,
         count(*) OVER ({over}) AS n
  FROM chunks)"""


def grouped(mode: str = "rows_per_group") -> str:
    groups = f"((n + {Q.workers - 1}) // {Q.workers})" if mode == "rows_per_group" else Q.workers
    return f"""grouped AS (
  SELECT *, idx % {groups} AS group_id, idx // {groups} AS rank FROM ordered)"""


# Every token gets its place in its group, then its block, the plain way.
def blocks(by: str = "") -> str:
    over = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    return f"""placed AS (
  SELECT {by}group_id, token,
         row_number() OVER (PARTITION BY {by}group_id ORDER BY rank, i) - 1 AS place
  FROM (SELECT {by}group_id, rank, generate_subscripts(ids, 1) AS i, unnest(ids) AS token
        FROM grouped)),
blocks AS (
  SELECT row_number() OVER ({over}ORDER BY group_id, block_no) - 1 AS block_id, *
  FROM (SELECT {by}group_id, place // {Q.context} AS block_no, list(token ORDER BY place) AS ids
        FROM placed GROUP BY ALL HAVING count(*) = {Q.context}))"""


_BLOCKS = blocks()

_BYTE_CHUNKS = f"{_BYTE_IDS},\n{chunked()}"
_BYTE_GROUPS = f"{_BYTE_CHUNKS},\n{ordered()},\n{grouped()}"
_BYTE_BLOCKS = f"{_BYTE_GROUPS},\n{_BLOCKS}"


def yields(by: str = "") -> str:
    kept = f"tokens // {Q.context} * {Q.context}"
    ending = f" GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by}sum(tokens)::BIGINT AS tokens_in, sum({kept})::BIGINT AS tokens_kept,
  sum(tokens - {kept})::BIGINT AS tokens_dropped,
  sum(tokens // {Q.context})::BIGINT AS blocks
FROM (SELECT {by}group_id, sum(len(ids)) AS tokens FROM grouped GROUP BY {by}group_id){ending}"""


# Byte chunks of the distinct stories, packed by split.
_SPLIT_BLOCKS = f"""{records()},
encoded AS (
  SELECT story_id, split, {byte_ids("CASE WHEN text LIKE ' %' THEN text ELSE ' ' || text END")} AS ids
  FROM (SELECT story_id, split, substr(text, 1, length(text) - {len(EOS)}) AS text FROM records)),
{chunked("split, ")}"""


def split_blocks(seed: int = Q.seed) -> str:
    return f"{_SPLIT_BLOCKS}, {ordered(seed, 'split, ')}, {grouped()}, {blocks('split, ')}"


_BATCHES = f"""positions AS (
  SELECT epoch::INT AS epoch, block_id,
         row_number() OVER (PARTITION BY epoch
           ORDER BY md5(({Q.seed} + epoch) || ':' || block_id)) - 1 AS i
  FROM blocks, range(0, {Q.epochs}) e(epoch)),
plan AS (
  SELECT epoch, block_id, i // {Q.batch} AS batch_no, i % {Q.batch} AS pos FROM positions)"""

def step_rows(plan: str, max_steps: int) -> str:
    return f"""
SELECT * FROM (
  SELECT *, epoch * ((SELECT max(batch_no) FROM {plan}) // {Q.accumulate} + 1)
            + batch_no // {Q.accumulate} AS optimizer_step
  FROM {plan})
WHERE optimizer_step < {max_steps}"""


_BLOCK_ROWS = f"SELECT block_id, group_id, block_no, {numbers('ids')} AS input_ids FROM blocks"

ORACLES = {
    "accepted_source_filter": f"""
SELECT doc_id AS story_id, source, text FROM documents WHERE source IN {_ACCEPTED}""",
    "story_strip": f"""
SELECT doc_id AS story_id, {stripped("text")} AS text FROM documents""",
    "exact_dedup": f"""
SELECT min(doc_id) AS story_id, story AS text, count(*) AS copies
FROM (SELECT doc_id, {stripped("text")} AS story FROM documents) GROUP BY story""",
    "duplicate_count": f"""
SELECT count(*) - count(DISTINCT {stripped("text")}) AS duplicates FROM documents""",
    "accepted_stories": f"""
WITH {stories(f"source IN {_ACCEPTED}")} SELECT story_id, split, text FROM stories""",
    "train_valid_split": f"""
WITH {stories()} SELECT story_id, split FROM stories""",
    "split_stats": f"""
WITH {stories()}
SELECT split, count(*) AS stories, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM stories GROUP BY split""",
    "corpus_counts": f"""
WITH {stories()} SELECT count(*) AS train_stories FROM stories WHERE split = 'train'""",
    "clean_lines": f"""
SELECT doc_id AS story_id, (generate_subscripts({_LINES}, 1) - 1)::INT AS line_no,
       unnest({_LINES}) AS line
FROM documents""",
    "story_records": f"""
SELECT doc_id AS story_id, {_RECORD} AS text FROM documents""",
    "segment_stories": f"""
SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS story_no,
       {_RECORD} AS text
FROM documents""",
    "story_index": """
SELECT doc_id AS story_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents""",
    "feed_batches": f"""
SELECT story_id, i // {Q.feed_batch} AS batch_no, i % {Q.feed_batch} AS pos
FROM (SELECT doc_id AS story_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)""",
    "story_cap": f"""
WITH {stories()}
SELECT story_id, split
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY story_id) AS i FROM stories)
WHERE i <= {Q.max_stories}""",
    "nfkc": """
SELECT doc_id AS story_id, nfc_normalize(text) AS text FROM documents""",
    "pretokens": f"""
SELECT doc_id AS story_id, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS word
FROM (SELECT doc_id, {word_list("text")} AS w FROM documents)""",
    "word_counts": f"""
WITH {records()}, {_TRAIN_WORDS} SELECT word, freq FROM word_counts""",
    "byte_symbols": f"""
WITH {records()}, {_TRAIN_WORDS}
SELECT token_id, sum(freq)::BIGINT AS uses
FROM (SELECT unnest({byte_ids("word")}) AS token_id, freq FROM word_counts)
GROUP BY token_id""",
    "bpe_pair_counts": f"""
WITH {records()}, {_TRAIN_WORDS}
SELECT ids[i] AS left_id, ids[i + 1] AS right_id, sum(freq)::BIGINT AS freq
FROM (SELECT ids, freq, unnest(range(1, len(ids))) AS i
      FROM (SELECT {byte_ids("word")} AS ids, freq FROM word_counts))
GROUP BY ALL""",
    "bpe_merges": f"""
WITH RECURSIVE {training()}
SELECT rank::BIGINT AS rank, left_id::BIGINT AS left_id, right_id::BIGINT AS right_id,
       new_id::BIGINT AS new_id, freq::BIGINT AS freq
FROM merges""",
    "vocab": f"""
WITH RECURSIVE {training()},
tokens AS (
  SELECT 0 AS rank, [hex(encode('{EOS}'))]
    || [printf('%02X', b) FOR b IN range(33, 127) || range(161, 173) || range(174, 256)
                                   || range(0, 33) || range(127, 161) || [173]] AS names
  UNION ALL
  SELECT rank + 1, names || [names[left_id + 1] || names[right_id + 1]]
  FROM tokens JOIN merges USING (rank))
SELECT (generate_subscripts(names, 1) - 1)::BIGINT AS token_id, unnest(names) AS token,
       generate_subscripts(names, 1) = 1 AS special
FROM tokens WHERE rank = {_ROUNDS}""",
    "encode_stories": f"""
WITH RECURSIVE {training()}
SELECT story_id, split, {numbers("ids")} AS input_ids FROM encoded""",
    "token_use": f"""
WITH RECURSIVE {training()},
used AS (SELECT token_id, count(*) AS n FROM (SELECT unnest(ids) AS token_id FROM encoded) GROUP BY token_id)
SELECT t.i::BIGINT AS token_id, coalesce(n, 0)::BIGINT AS uses
FROM range(0, {Q.vocab_size}) t(i) LEFT JOIN used ON used.token_id = t.i""",
    "decode_roundtrip": f"""
WITH {records()}
SELECT story_id, CASE WHEN text LIKE ' %' THEN text ELSE ' ' || text END AS text FROM records""",
    "chunk_tokens": f"""
WITH {_BYTE_CHUNKS}
SELECT story_id, chunk_no, {numbers("ids")} AS input_ids FROM chunks""",
    "chunk_features": f"""
WITH {_BYTE_CHUNKS}
SELECT story_id, chunk_no, {numbers("[0 FOR x IN ids]")} AS token_type_ids,
       {numbers("[1 FOR x IN ids]")} AS attention_mask, len(ids) AS length,
       0::BIGINT AS overflow_to_sample_mapping
FROM chunks""",
    "feature_rows": f"""
WITH {_BYTE_IDS}
SELECT story_id, len(ids) AS tokens, list_sum(ids)::BIGINT AS sum_input_ids,
       0::BIGINT AS sum_token_type_ids, len(ids) AS sum_attention_mask
FROM encoded""",
    "parse_int_list": f"""
WITH {_BYTE_CHUNKS}
SELECT story_id, chunk_no, len(ids)::INT AS numbers, list_sum(ids)::BIGINT AS total FROM chunks""",
    "shuffle_order": f"""
WITH {_BYTE_CHUNKS}, {ordered()} SELECT story_id, chunk_no, idx FROM ordered""",
    "epoch_order": f"""
WITH {_BYTE_CHUNKS}, {ordered(Q.seed + 1)}
SELECT 1 AS epoch, story_id, chunk_no, idx FROM ordered""",
    "pack_groups": f"""
WITH {_BYTE_GROUPS} SELECT story_id, chunk_no, idx, group_id, rank FROM grouped""",
    "pack_blocks": f"""
WITH {_BYTE_BLOCKS} {_BLOCK_ROWS}""",
    "pack_blocks_n_groups": f"""
WITH {_BYTE_CHUNKS}, {ordered()}, {grouped("n_groups")}, {_BLOCKS} {_BLOCK_ROWS}""",
    "packing_yield": f"""
WITH {_BYTE_GROUPS} {yields()}""",
    "block_limit": f"""
WITH {_BYTE_BLOCKS} {_BLOCK_ROWS} ORDER BY block_id LIMIT {Q.row_limit}""",
    "block_lookup": f"""
WITH {_BYTE_BLOCKS} {_BLOCK_ROWS} WHERE block_id IN {Q.positions}""",
    "batch_plan": f"""
WITH {_BYTE_BLOCKS}, {_BATCHES} SELECT epoch, block_id, batch_no, pos FROM plan""",
    "batch_plan_valid": f"""
WITH {_BYTE_BLOCKS}
SELECT 0 AS epoch, block_id, block_id // {Q.batch} AS batch_no, block_id % {Q.batch} AS pos
FROM blocks""",
    "step_plan": f"""
WITH {_BYTE_BLOCKS}, {_BATCHES}
SELECT * FROM (
  SELECT *, epoch * ((SELECT max(batch_no) FROM plan) // {Q.accumulate} + 1)
            + batch_no // {Q.accumulate} AS optimizer_step
  FROM plan)
WHERE optimizer_step < {Q.max_steps}""",
    "next_token_pairs": f"""
WITH {_BYTE_BLOCKS}
SELECT block_id, {numbers(f"ids[1 : {Q.context - 1}]")} AS inputs,
       {numbers(f"ids[2 : {Q.context}]")} AS targets
FROM blocks""",
    "corpus_to_blocks": f"""
WITH RECURSIVE {training(f"source IN {_ACCEPTED}")},
{chunked("split, ")}, {ordered(by="split, ")}, {grouped()}, {blocks("split, ")}
SELECT split, block_id, group_id, block_no, {numbers('ids')} AS input_ids FROM blocks""",
    "corpus_yield": f"""
WITH RECURSIVE {training(f"source IN {_ACCEPTED}")},
{chunked("split, ")}, {ordered(by="split, ")}, {grouped()}
{yields("split, ")}""",
    # Full vocabularies, with answers that need no merges.
    "decode_roundtrip_8192": f"""
WITH {records()}
SELECT story_id, CASE WHEN text LIKE ' %' THEN text ELSE ' ' || text END AS text FROM records""",
    "chunk_roundtrip_8192": f"""
WITH {records()}
SELECT story_id, CASE WHEN text LIKE ' %' THEN text ELSE ' ' || text END AS text FROM records""",
    "fine_split": f"""
WITH {stories()} SELECT story_id, {split_of("text", Q.fine_ratio)} AS split FROM stories""",
    # Texts changed so that the operator has work to do.
    "nfkc_wide": """
SELECT doc_id AS story_id, nfc_normalize(text) AS text FROM documents""",
    "story_strip_padded": f"""
SELECT doc_id AS story_id, {stripped("text")} AS text FROM documents""",
    "clean_lines_padded": f"""
SELECT doc_id AS story_id, (generate_subscripts({_LINES}, 1) - 1)::INT AS line_no,
       unnest({_LINES}) AS line
FROM documents""",
    "segment_marked": rf"""
WITH l AS (
  SELECT file, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, len(ls) AS n
  FROM (SELECT source AS file, doc_id, {_LINES} AS ls FROM documents)),
p AS (
  SELECT *, 2 * coalesce(sum((i < n)::INT) OVER (PARTITION BY file ORDER BY doc_id, i
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS story_no,
         2 * sum((i < n)::INT) OVER (PARTITION BY file) AS total
  FROM l)
SELECT file, story_no::BIGINT AS story_no,
       string_agg(line, chr(10) ORDER BY doc_id, i) || chr(10) || '{EOS}' AS text
FROM p WHERE story_no < total GROUP BY file, story_no
UNION ALL
SELECT file, (2 * b + 1)::BIGINT, chr(10) || '{EOS}'
FROM (SELECT file, unnest(range(0, (total // 2)::BIGINT)) AS b FROM (SELECT DISTINCT file, total FROM p))""",
    "epoch_blocks": f"""
WITH {split_blocks(Q.seed + 1)}
SELECT split, block_id, group_id, block_no, {numbers('ids')} AS input_ids FROM blocks""",
    "train_steps": f"""
WITH {split_blocks()},
positions AS (
  SELECT epoch::INT AS epoch, block_id,
         row_number() OVER (PARTITION BY epoch
           ORDER BY md5(({Q.seed} + epoch) || ':' || block_id)) - 1 AS i
  FROM (SELECT * FROM blocks WHERE split = 'train'), range(0, {Q.many_steps}) e(epoch)),
plan AS (
  SELECT epoch, block_id, i // {Q.batch} AS batch_no, i % {Q.batch} AS pos FROM positions)
{step_rows("plan", Q.many_steps)}""",
    "valid_batches": f"""
WITH {split_blocks()}
SELECT 0 AS epoch, block_id, block_id // {Q.batch} AS batch_no, block_id % {Q.batch} AS pos
FROM blocks WHERE split = 'valid'""",
}
