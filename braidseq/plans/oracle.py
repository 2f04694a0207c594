"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from .inputs import ALTERED_SQL, CONTIGS_SQL, HITS_SQL, PIECES_SQL, TILES_SQL, UNFOLDED_HITS_SQL, WHOLE_AND_TILES_SQL

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"

_MEMBERS = f"""keyed AS (
  SELECT *, CASE WHEN sequence <= {_RC.format('sequence')} THEN '+' ELSE '-' END AS orientation, least(sequence, {_RC.format('sequence')}) AS canon FROM contigs
), members AS (
  SELECT *, 'ctg_' || sha256(canon) AS catalogue_id,
         row_number() OVER (PARTITION BY canon ORDER BY orientation <> '+', source_sample, original_identifier, identifier) AS place,
         count(*) OVER (PARTITION BY canon) AS group_size
  FROM keyed
)"""

_SEEDS = """seqs AS (
  SELECT catalogue_id AS sequence_id, canon AS sequence, length(canon) AS len FROM members WHERE place = 1
), kmers AS (
  SELECT sequence_id, len, p, substr(sequence, p + 1, 21) AS f, least(10, len - 20) AS w
  FROM (SELECT *, unnest(range(len - 20)) AS p FROM seqs WHERE len >= 21)
), hashed AS (
  SELECT sequence_id, len, w, p, least(f, r) AS kmer, CASE WHEN f <= r THEN '+' ELSE '-' END AS orientation, substr(sha256(least(f, r)), 1, 16) AS value
  FROM (SELECT *, reverse(translate(f, 'ACGT', 'TGCA')) AS r FROM kmers)
), minima AS (
  SELECT *, CASE WHEN p >= w - 1 THEN min(value) OVER (PARTITION BY sequence_id ORDER BY p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS wmin FROM hashed
), obs AS (
  SELECT sequence_id, len, value, kmer, p AS position, orientation
  FROM (SELECT *, max(wmin) OVER (PARTITION BY sequence_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS best FROM minima) WHERE value = best
), freq AS (
  SELECT value, kmer, count(*) AS frequency FROM obs GROUP BY ALL
)"""

_PAIRS = """kept AS (
  SELECT obs.* FROM obs JOIN freq USING (value, kmer) WHERE frequency <= 100
), pairs AS (
  SELECT a.sequence_id AS query_id, b.sequence_id AS target_id, a.kmer, a.position AS qp, b.position AS tp, a.len AS ql, b.len AS tl,
         CASE WHEN a.orientation = b.orientation THEN '+' ELSE '-' END AS relative
  FROM kept a JOIN kept b ON a.value = b.value AND a.kmer = b.kmer AND a.sequence_id < b.sequence_id
)"""

_CANDIDATES = """flags AS (
  SELECT query_id, target_id, count(DISTINCT kmer) AS shared_minimisers,
         bool_or(relative = '+') AS af, bool_or(relative = '-') AS ar,
         bool_or(relative = '+' AND qp < 1000) AS qpf, bool_or(relative = '+' AND qp + 21 > ql - 1000) AS qsf,
         bool_or(relative = '-' AND qp < 1000) AS qpr, bool_or(relative = '-' AND qp + 21 > ql - 1000) AS qsr,
         bool_or(relative = '+' AND tp < 1000) AS tpf, bool_or(relative = '+' AND tp + 21 > tl - 1000) AS tsf,
         bool_or(relative = '-' AND tp < 1000) AS tpr, bool_or(relative = '-' AND tp + 21 > tl - 1000) AS tsr
  FROM pairs GROUP BY query_id, target_id
), candidates AS (
  SELECT query_id, target_id, shared_minimisers, CASE WHEN af AND ar THEN NULL WHEN af THEN '+' ELSE '-' END AS orientation,
         CASE WHEN af AND ar THEN '+,-' WHEN af THEN '+' ELSE '-' END AS supported_orientations,
         array_to_string(list_sort(list_filter([
           CASE WHEN qsf AND tpf THEN 'QUERY_SUFFIX_TO_TARGET_PREFIX' END, CASE WHEN qpf AND tsf THEN 'TARGET_SUFFIX_TO_QUERY_PREFIX' END,
           CASE WHEN qpf AND qsf THEN 'QUERY_CONTAINMENT_POSSIBLE' END, CASE WHEN tpf AND tsf THEN 'TARGET_CONTAINMENT_POSSIBLE' END,
           CASE WHEN qsr AND tsr THEN 'QUERY_SUFFIX_TO_TARGET_PREFIX_REVERSE' END, CASE WHEN qpr AND tpr THEN 'TARGET_SUFFIX_TO_QUERY_PREFIX_REVERSE' END,
           CASE WHEN qpr AND qsr THEN 'QUERY_CONTAINMENT_POSSIBLE_REVERSE' END, CASE WHEN tpr AND tsr THEN 'TARGET_CONTAINMENT_POSSIBLE_REVERSE' END],
           lambda x: x IS NOT NULL)), ',') AS terminal_topologies,
         'canonical positional minimisers support terminal geometry' || CASE WHEN af AND ar THEN '; orientation evidence is ambiguous' ELSE '' END AS reasons
  FROM flags WHERE shared_minimisers >= 5
)"""

_DIAGONALS = """diagonals AS (
  SELECT DISTINCT query_id, target_id, relative AS orientation, ql, tl, qp - CASE WHEN relative = '+' THEN tp ELSE tl - 21 - tp END AS d
  FROM pairs SEMI JOIN (SELECT * FROM candidates WHERE terminal_topologies <> '') c USING (query_id, target_id)
), laid AS (
  SELECT *, greatest(0, d) AS qs, least(ql, tl + d) AS qe FROM diagonals
), placed AS (
  SELECT *, CASE WHEN orientation = '+' THEN qs - d ELSE tl - (qe - d) END AS ts, CASE WHEN orientation = '+' THEN qe - d ELSE tl - (qs - d) END AS te
  FROM laid WHERE qe - qs >= 500
), hits AS (
  SELECT query_id, target_id, ql::INT AS query_length, qs::INT AS query_start, qe::INT AS query_end, orientation, tl::INT AS target_length, ts::INT AS target_start, te::INT AS target_end,
         (qe - qs - hamming(x, y))::INT AS matching_bases,
         (qe - qs)::INT AS alignment_block_length, NULL::INT AS mapping_quality
  FROM (
    SELECT p.*, substr(a.sequence, qs + 1, qe - qs) AS x,
           CASE WHEN orientation = '+' THEN substr(b.sequence, ts + 1, te - ts) ELSE reverse(translate(substr(b.sequence, ts + 1, te - ts), 'ACGT', 'TGCA')) END AS y
    FROM placed p JOIN seqs a ON a.sequence_id = query_id JOIN seqs b ON b.sequence_id = target_id
  )
)"""

_OPEN_HITS = "hits AS (" + UNFOLDED_HITS_SQL.replace("AS STRING", "AS VARCHAR") + ")"

_LINE_HITS = "hits AS (" + HITS_SQL.replace("AS STRING", "AS VARCHAR") + ")"

_CLASSIFIED = """measured AS (
  SELECT *, matching_bases / alignment_block_length AS identity, (query_end - query_start) / query_length AS qcov, (target_end - target_start) / target_length AS tcov,
         query_length - query_end AS qed, target_length - target_end AS ted,
         CASE WHEN orientation = '+' THEN target_start ELSE target_length - target_end END AS near_start,
         CASE WHEN orientation = '+' THEN target_length - target_end ELSE target_start END AS near_end
  FROM hits
), ruled AS (
  SELECT *, CASE
    WHEN alignment_block_length = 0 THEN 1 WHEN identity < 0.98 THEN 2
    WHEN query_start <= 50 AND qed <= 50 AND target_start <= 50 AND ted <= 50 AND qcov >= 0.98 AND tcov >= 0.98 AND matching_bases = alignment_block_length AND query_length = target_length THEN 3
    WHEN alignment_block_length >= 500 AND query_start <= 50 AND qed <= 50 AND qcov >= 0.98 AND query_length <= target_length THEN 4
    WHEN alignment_block_length >= 500 AND target_start <= 50 AND ted <= 50 AND tcov >= 0.98 AND target_length <= query_length THEN 5
    WHEN alignment_block_length < 1000 THEN 6
    WHEN qed <= 50 AND near_start <= 50 AND query_start <= 50 AND near_end <= 50 THEN 7
    WHEN qed <= 50 AND near_start <= 50 THEN 8 WHEN query_start <= 50 AND near_end <= 50 THEN 9 ELSE 10 END AS rule
  FROM measured
), classified AS (
  SELECT *, ['NO_RELATIONSHIP','NO_RELATIONSHIP','EXACT_MATCH','QUERY_CONTAINED_IN_TARGET','TARGET_CONTAINED_IN_QUERY','NO_RELATIONSHIP','AMBIGUOUS_OVERLAP',
             'QUERY_SUFFIX_TO_TARGET_PREFIX','TARGET_SUFFIX_TO_QUERY_PREFIX','NO_RELATIONSHIP'][rule] AS relationship_type,
         ['rejected','rejected','confident','candidate','candidate','rejected','ambiguous','candidate','candidate','rejected'][rule] AS status,
         ['zero length','below identity threshold','full exact span','query covered end-to-end','target covered end-to-end','below minimum overlap',
          'alignment satisfies competing terminal topologies','compatible terminal geometry','compatible terminal geometry','alignment lacks compatible terminal geometry'][rule] AS reason
  FROM ruled
)"""

_DECIDED = """ranked AS (
  SELECT *, relationship_type <> 'NO_RELATIONSHIP' AS accepted,
         row_number() OVER (PARTITION BY query_id, target_id ORDER BY relationship_type = 'NO_RELATIONSHIP', query_length, query_start, query_end, orientation, target_length, target_start,
                            target_end, matching_bases, alignment_block_length, coalesce(mapping_quality, -1)) AS place
  FROM (SELECT DISTINCT * FROM classified)
), compared AS (
  SELECT r.*, accepted AND r.relationship_type <> f.relationship_type AS by_type, accepted AND r.orientation <> f.orientation AS by_strand,
         accepted AND greatest(abs(r.query_start - f.query_start), abs(r.query_end - f.query_end), abs(r.target_start - f.target_start), abs(r.target_end - f.target_end)) > 50 AS by_place
  FROM ranked r JOIN (SELECT query_id, target_id, relationship_type, orientation, query_start, query_end, target_start, target_end FROM ranked WHERE place = 1) f USING (query_id, target_id)
), grouped AS (
  SELECT query_id, target_id, count(*) FILTER (accepted) AS accepted_hits, count(*) FILTER (NOT accepted) AS rejected_hits,
         bool_or(by_type) AS by_type, bool_or(by_strand) AS by_strand, bool_or(by_place) AS by_place,
         string_agg(DISTINCT reason, '; ' ORDER BY reason) FILTER (NOT accepted) AS rejections
  FROM compared GROUP BY query_id, target_id
), decided AS (
  SELECT g.query_id, g.target_id, CASE WHEN torn THEN 'AMBIGUOUS_OVERLAP' ELSE r.relationship_type END AS relationship_type, r.orientation, r.identity,
         r.alignment_block_length AS aligned_length, CASE WHEN torn THEN 'ambiguous' ELSE r.status END AS status,
         CASE WHEN torn THEN array_to_string(list_filter([CASE WHEN by_strand THEN 'accepted hits imply incompatible orientations' END,
                CASE WHEN by_type THEN 'accepted hits imply incompatible relationship types or terminal topologies' END,
                CASE WHEN by_place THEN 'accepted hits imply materially different coordinate placements' END], lambda x: x IS NOT NULL), '; ')
              WHEN accepted_hits = 0 THEN rejections ELSE r.reason END AS reasons,
         accepted_hits, rejected_hits, r.query_start, r.query_end, r.target_start, r.target_end
  FROM (SELECT *, accepted_hits > 0 AND (by_type OR by_strand OR by_place) AS torn FROM grouped) g
  JOIN ranked r ON r.query_id = g.query_id AND r.target_id = g.target_id AND r.place = 1
)"""

_ONE_WAY_EDGES = """edges AS (
  SELECT 'edge_' || substr(sha256(least(query_id, target_id) || chr(0) || greatest(query_id, target_id) || chr(0) || kind), 1, 20) AS edge_id, *
  FROM (SELECT *, CASE WHEN relationship_type = 'AMBIGUOUS_OVERLAP' THEN 'ambiguous' WHEN relationship_type LIKE '%CONTAINED%' THEN 'containment' ELSE 'overlap' END AS kind
        FROM decided WHERE relationship_type NOT IN ('EXACT_MATCH', 'NO_RELATIONSHIP'))
)"""

_READS = """reads AS (
  SELECT 'r' || event_id % 4000 AS name, 'ref' || user_id % 40 AS reference, (event_id * 37 % 900)::INT AS pos, (event_id % 61)::INT AS mapq, event_id % 5 AS shape FROM events
), shapes(shape, lo, hi) AS (VALUES (0, 0, 120), (1, 0, 40), (1, 50, 110), (2, 0, 110), (3, 0, 90), (4, 0, 50), (4, 250, 300)
), blocks AS (SELECT reads.*, pos + lo AS start, pos + hi AS stop FROM reads JOIN shapes USING (shape))"""

_SPANNING = """spanning AS (
  SELECT case_id, count(DISTINCT name) AS remapped_reads, count(DISTINCT CASE WHEN start <= 430 AND stop >= 470 THEN name END) AS spanning_reads
  FROM (SELECT 'case' || i AS case_id, 'ref' || i AS reference FROM range(40) t(i)) j LEFT JOIN (SELECT * FROM blocks WHERE mapq >= 20) b USING (reference) GROUP BY case_id
), rated AS (SELECT *, CASE WHEN remapped_reads > 0 THEN spanning_reads / remapped_reads ELSE 0 END AS fraction FROM spanning)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts)


_TILE_HITS = (TILES_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES, _DIAGONALS)
_WHOLE_HITS = (CONTIGS_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES, _DIAGONALS)


def _joined(name: str, ways: str) -> str:
    """``name`` (n, root): the least node that each node of ``ways`` (a, b; both directions) reaches."""
    return f"""{name}(n, root) USING KEY (n) AS (
  SELECT DISTINCT a, a FROM {ways}
  UNION
  SELECT w.b, min({name}.root) FROM {name} JOIN {ways} w ON w.a = {name}.n JOIN recurring.{name} AS now ON now.n = w.b WHERE {name}.root < now.root GROUP BY w.b
)"""


#: From ``edges`` and ``nodes`` (n) to ``labels`` (n, component_id, members) and ``components`` with their reasons.
_GRAPH = f"""ways AS (SELECT query_id AS a, target_id AS b FROM edges UNION SELECT target_id, query_id FROM edges),
{_joined('cc', 'ways')}, rooted AS (
  SELECT n, coalesce(root, n) AS root FROM nodes LEFT JOIN cc USING (n)
), named AS (
  SELECT root, count(*) AS members, 'component_' || substr(sha256(string_agg(n, chr(0) ORDER BY n)), 1, 20) AS component_id FROM rooted GROUP BY root
), labels AS (
  SELECT n, component_id, members FROM rooted JOIN named USING (root)
), lapped AS (
  SELECT e.*, component_id FROM edges e JOIN labels ON n = query_id WHERE kind = 'overlap'
), ports AS (
  SELECT edge_id, component_id, query_id AS node, CASE WHEN ahead THEN 'suffix' ELSE 'prefix' END AS port, target_id AS other FROM (SELECT *, relationship_type = 'QUERY_SUFFIX_TO_TARGET_PREFIX' AS ahead FROM lapped)
  UNION ALL
  SELECT edge_id, component_id, target_id, CASE WHEN (relationship_type = 'QUERY_SUFFIX_TO_TARGET_PREFIX') = (orientation = '+') THEN 'prefix' ELSE 'suffix' END, query_id FROM lapped
), inside AS (
  SELECT edge_id, component_id, CASE WHEN inner_query THEN query_id ELSE target_id END AS child, CASE WHEN inner_query THEN target_id ELSE query_id END AS parent,
         CASE WHEN inner_query THEN target_start ELSE query_start END AS parent_start, CASE WHEN inner_query THEN target_end ELSE query_end END AS parent_end
  FROM (SELECT e.*, component_id, relationship_type = 'QUERY_CONTAINED_IN_TARGET' AS inner_query FROM edges e JOIN labels ON n = query_id WHERE kind = 'containment')
), overlap_ways AS (SELECT query_id AS a, target_id AS b FROM lapped UNION SELECT target_id, query_id FROM lapped),
{_joined('oc', 'overlap_ways')}, cycles AS (
  SELECT DISTINCT component_id FROM (SELECT root, component_id, count(*) AS edges FROM lapped JOIN oc ON oc.n = query_id GROUP BY ALL)
  JOIN (SELECT root, count(*) AS nodes FROM oc GROUP BY root) USING (root) WHERE edges >= nodes
), cover AS (
  SELECT query_id || s AS a, target_id || CASE WHEN orientation = '+' THEN s WHEN s = '+' THEN '-' ELSE '+' END AS b FROM lapped, (VALUES ('+'), ('-')) t(s)
), cover_ways AS (SELECT a, b FROM cover UNION SELECT b, a FROM cover),
{_joined('sc', 'cover_ways')}, conflicts AS (
  SELECT DISTINCT component_id FROM (SELECT left(n, length(n) - 1) AS n, root FROM sc GROUP BY ALL HAVING count(*) > 1) JOIN labels USING (n)
), components AS (
  SELECT l.component_id, l.nodes, coalesce(c.edges, 0) AS edges, coalesce(c.overlap_edges, 0) AS overlap_edges, coalesce(c.containment_edges, 0) AS containment_edges,
         array_to_string(list_filter([
           CASE WHEN c.vague > 0 THEN 'component contains ambiguous pairwise evidence' END,
           CASE WHEN l.component_id IN (SELECT component_id FROM inside GROUP BY component_id, child HAVING count(*) > 1) THEN 'contained sequence has multiple possible containers' END,
           CASE WHEN l.component_id IN (SELECT component_id FROM ports GROUP BY component_id, node, port HAVING count(*) > 1) THEN 'multiple overlaps compete for the same oriented terminal' END,
           CASE WHEN l.component_id IN (SELECT component_id FROM cycles) THEN 'overlap subgraph contains a cycle' END,
           CASE WHEN l.component_id IN (SELECT component_id FROM conflicts) THEN 'overlap orientations are mutually inconsistent' END], lambda x: x IS NOT NULL), '; ') AS ambiguity_reasons
  FROM (SELECT component_id, count(*) AS nodes FROM labels GROUP BY 1) l
  LEFT JOIN (SELECT component_id, count(*) AS edges, count(*) FILTER (kind = 'overlap') AS overlap_edges, count(*) FILTER (kind = 'containment') AS containment_edges,
                    count(*) FILTER (kind = 'ambiguous') AS vague FROM edges JOIN labels ON n = query_id GROUP BY 1) c USING (component_id)
)"""

#: From the graph, ``seqs`` (sequence_id, sequence, len) and ``members`` to decisions, paths, outputs and provenance.
_RECONCILED = f"""contained AS (
  SELECT i.edge_id, child, parent, parent_start, parent_end, list_concat(
           CASE WHEN ambiguity_reasons <> '' THEN list_concat(['component ambiguity prevents containment disposition'], string_split(ambiguity_reasons, '; ')) ELSE []::VARCHAR[] END,
           CASE WHEN count(*) OVER (PARTITION BY child) <> 1 AND NOT contains(ambiguity_reasons, 'contained sequence has multiple') THEN ['contained sequence has multiple possible containers'] ELSE []::VARCHAR[] END) AS why
  FROM inside i JOIN components USING (component_id)
), supported AS (
  SELECT edge_id FROM lapped o JOIN seqs a ON a.sequence_id = query_id JOIN seqs b ON b.sequence_id = target_id
  WHERE query_end > query_start AND query_end - query_start = target_end - target_start AND query_end - query_start = aligned_length
    AND CASE WHEN relationship_type = 'QUERY_SUFFIX_TO_TARGET_PREFIX' THEN a.len - query_end ELSE query_start END <= 50
    AND CASE WHEN (relationship_type = 'QUERY_SUFFIX_TO_TARGET_PREFIX') = (orientation = '+') THEN target_start ELSE b.len - target_end END <= 50
    AND substr(a.sequence, query_start + 1, query_end - query_start) = CASE WHEN orientation = '+' THEN substr(b.sequence, target_start + 1, target_end - target_start)
          ELSE {_RC.format('substr(b.sequence, target_start + 1, target_end - target_start)')} END
), decisions AS (
  SELECT component_id, c.overlap_edges, u.unsupported, list_filter([
           CASE WHEN ambiguity_reasons <> '' THEN 'component ambiguity prevents overlap path eligibility' END,
           CASE WHEN containment_edges > 0 THEN 'containment and overlap evidence require provenance-complete joint planning' END,
           CASE WHEN unsupported > 0 THEN 'one or more proposed junctions lack explicit support' END], lambda x: x IS NOT NULL) AS why
  FROM (SELECT component_id, count(*) FILTER (edge_id NOT IN (SELECT edge_id FROM supported)) AS unsupported FROM lapped GROUP BY 1) u JOIN components c USING (component_id)
), open_ports AS (
  SELECT p.* FROM ports p JOIN decisions d USING (component_id) WHERE len(d.why) = 0
), moves AS (
  SELECT a.component_id, a.node, a.port AS leave, a.edge_id, b.node AS next, CASE WHEN b.port = 'prefix' THEN 'suffix' ELSE 'prefix' END AS next_leave
  FROM open_ports a JOIN open_ports b ON a.edge_id = b.edge_id AND a.node = b.other AND a.other = b.node
), heads AS (
  SELECT component_id, min(node) AS node FROM (SELECT component_id, node FROM open_ports GROUP BY ALL HAVING count(*) = 1) GROUP BY 1
), walk AS (
  SELECT h.component_id, h.node, p.port AS leave, 0 AS step FROM heads h JOIN open_ports p USING (component_id, node)
  UNION ALL
  SELECT w.component_id, m.next, m.next_leave, w.step + 1 FROM walk w JOIN moves m ON m.node = w.node AND m.leave = w.leave AND m.component_id = w.component_id
), steps AS (
  SELECT w.component_id, w.step, w.node, CASE WHEN w.leave = 'suffix' THEN '+' ELSE '-' END AS strand, m.edge_id FROM walk w LEFT JOIN moves m USING (component_id, node, leave)
), paths AS (
  SELECT s.*, path_id FROM steps s JOIN (
    SELECT component_id, 'path_' || substr(sha256(component_id || chr(0) || string_agg(node || ':' || strand, chr(0) ORDER BY step) || chr(0) || string_agg(edge_id, chr(0) ORDER BY step)), 1, 20) AS path_id
    FROM steps GROUP BY 1) USING (component_id)
), laid_out AS (
  SELECT p.*, CASE WHEN strand = '+' THEN s.sequence ELSE {_RC.format('s.sequence')} END AS bases, coalesce(o.query_end - o.query_start, 0) AS span, o.query_id, o.orientation,
         substr(q.sequence, o.query_start + 1, o.query_end - o.query_start) AS part
  FROM paths p JOIN seqs s ON s.sequence_id = p.node LEFT JOIN lapped o USING (edge_id) LEFT JOIN seqs q ON q.sequence_id = o.query_id
), checked AS (
  SELECT *, sum(length(bases) - span) OVER w - (length(bases) - span) AS output_start, lag(span, 1, 0) OVER w AS cut,
         edge_id IS NOT NULL AND NOT (right(bases, span) = own AND left(lead(bases) OVER w, span) = own) AS bad
  FROM (SELECT *, CASE WHEN (CASE WHEN query_id = node THEN strand WHEN orientation = '+' THEN strand WHEN strand = '+' THEN '-' ELSE '+' END) = '+' THEN part ELSE {_RC.format('part')} END AS own FROM laid_out)
  WINDOW w AS (PARTITION BY path_id ORDER BY step)
), merged AS (
  SELECT path_id, 'merge_' || substr(path_id, 6, 20) AS output_sequence, string_agg(substr(bases, cut + 1), '' ORDER BY step) AS sequence, bool_or(bad) AS failed FROM checked GROUP BY path_id
), lifted AS (
  SELECT child, parent AS root, parent_start AS output_start, parent_end AS output_end, 0 AS level FROM contained WHERE len(why) = 0
  UNION ALL
  SELECT l.child, c.parent, (c.parent_start + floor(l.output_start * (c.parent_end - c.parent_start) / s.len))::INT, (c.parent_start + floor(l.output_end * (c.parent_end - c.parent_start) / s.len))::INT, level + 1
  FROM lifted l JOIN (SELECT * FROM contained WHERE len(why) = 0) c ON c.child = l.root JOIN seqs s ON s.sequence_id = c.child
), roots AS (
  SELECT * FROM lifted QUALIFY row_number() OVER (PARTITION BY child ORDER BY level DESC) = 1
), remaining AS (
  SELECT * FROM seqs WHERE sequence_id NOT IN (SELECT node FROM checked JOIN merged USING (path_id) WHERE NOT failed) AND sequence_id NOT IN (SELECT child FROM roots)
), outputs AS (
  SELECT output_sequence, length(sequence)::INT AS length, md5(sequence) AS sequence_md5, 'conservative conflict-free terminal-overlap merge' AS description FROM merged WHERE NOT failed
  UNION ALL SELECT sequence_id, len::INT, md5(sequence), 'canonical catalogue representative' FROM remaining
), provenance AS (
  SELECT g.output_sequence, m.source_sample, m.original_identifier AS source_contig, 'TERMINAL_OVERLAP' AS relationship, CASE WHEN m.orientation = c.strand THEN '+' ELSE '-' END AS orientation, 0 AS source_start,
         length(m.sequence)::INT AS source_end, c.output_start::INT AS output_start, (c.output_start + length(c.bases))::INT AS output_end, 1.0::DOUBLE AS identity, 'constructed_path' AS disposition,
         'exact terminal overlap; no evidence required' AS decision_reason, 'none' AS evidence_mode
  FROM members m JOIN checked c ON c.node = m.catalogue_id JOIN merged g USING (path_id) WHERE NOT failed
  UNION ALL SELECT k.sequence_id, m.source_sample, m.original_identifier, 'EXACT_MATCH', m.orientation, 0, length(m.sequence)::INT, 0, length(m.sequence)::INT, 1.0::DOUBLE,
         CASE WHEN m.place = 1 THEN 'canonical representative' ELSE 'exact duplicate' END, 'exact or reverse-complement catalogue identity', 'none' FROM members m JOIN remaining k ON k.sequence_id = m.catalogue_id
  UNION ALL SELECT r.root, m.source_sample, m.original_identifier, 'CONTAINMENT', m.orientation, 0, length(m.sequence)::INT, r.output_start::INT, r.output_end::INT, 1.0::DOUBLE, 'contained_removed',
         'unique containment creates no new sequence junction', 'none' FROM members m JOIN roots r ON r.child = m.catalogue_id
), reports AS (
  SELECT path_id AS component_or_pair, 'path junction is not an exact terminal join' AS reason FROM merged WHERE failed
  UNION SELECT component_id, CASE WHEN ambiguity_reasons <> '' THEN ambiguity_reasons ELSE 'component deferred by conservative policy' END FROM components
        WHERE ambiguity_reasons <> '' OR component_id IN (SELECT component_id FROM decisions WHERE len(why) > 0)
  UNION SELECT query_id || ':' || target_id, reasons FROM decided WHERE relationship_type = 'AMBIGUOUS_OVERLAP'
)"""

_TILE_GRAPH = (*_TILE_HITS, _CLASSIFIED, _DECIDED, _ONE_WAY_EDGES, "nodes AS (SELECT sequence_id AS n FROM seqs)", _GRAPH)
_TILE_RUN = (*_TILE_GRAPH, _RECONCILED)
_JOINT_RUN = (WHOLE_AND_TILES_SQL, *_TILE_RUN[1:])
_PIECE_RUN = (PIECES_SQL, *_TILE_RUN[1:])
_LINE_GRAPH = (_OPEN_HITS, _CLASSIFIED, _DECIDED, _ONE_WAY_EDGES, "nodes AS (SELECT DISTINCT n FROM (SELECT query_id AS n FROM hits UNION ALL SELECT target_id FROM hits))", _GRAPH)
_STATS = """ SELECT (SELECT count(*) FROM members) AS sources, (SELECT count(*) FROM members WHERE place > 1) AS duplicates_collapsed, (SELECT count(*) FROM members WHERE orientation = '-') AS reverse_members,
        (SELECT count(*) FROM seqs) AS canonical_sequences, (SELECT count(*) FROM outputs) AS output_sequences, (SELECT count(*) FROM merged WHERE NOT failed) AS merged_linear_paths,
        (SELECT count(*) FROM edges WHERE kind = 'overlap') AS overlap_edges, (SELECT count(*) FROM edges WHERE kind = 'containment') AS containment_edges,
        (SELECT count(*) FROM edges WHERE kind = 'ambiguous') AS ambiguous_edges, (SELECT count(*) FROM provenance WHERE disposition = 'contained_removed') AS contained_members,
        (SELECT count(*) FROM provenance) AS provenance_rows"""
_HIT_COLUMNS = " SELECT query_id, target_id, query_length, query_start, query_end, orientation, target_length, target_start, target_end, matching_bases, alignment_block_length FROM hits"

_TYPES = "'EXACT_MATCH','QUERY_CONTAINED_IN_TARGET','TARGET_CONTAINED_IN_QUERY','QUERY_SUFFIX_TO_TARGET_PREFIX','TARGET_SUFFIX_TO_QUERY_PREFIX'"
_SPARSE = """told AS (
  SELECT query_id, target_id, CASE WHEN query_id LIKE '%1' THEN 'NO_RELATIONSHIP' ELSE relationship_type END AS expected, CASE WHEN target_id LIKE '%2' THEN '+' ELSE orientation END AS strand,
         NOT query_id LIKE '%1' AS allowed, CASE WHEN target_id LIKE '%3' THEN 'group' || target_id ELSE '' END AS put_off FROM decided
), truth AS (
  SELECT * FROM told WHERE NOT target_id LIKE '%5' UNION ALL SELECT query_id, 'x' || target_id, expected, strand, allowed, put_off FROM told WHERE target_id LIKE '%6'
)"""

_REPORTS = """judged AS (
  SELECT case_id, 's0' AS sample, remapped_reads, spanning_reads FROM spanning UNION ALL
  SELECT case_id, 's1', CASE WHEN case_id LIKE '%0' THEN 0 ELSE remapped_reads END, CASE WHEN case_id LIKE '%0' THEN 0 ELSE greatest(spanning_reads - 3, 0) END FROM spanning
), truth AS (SELECT 'case' || i AS case_id, i % 3 > 0 AS ok FROM range(45) t(i))"""


def _swept(most: int) -> str:
    parts = [x.replace("<= 100", f"<= {most}") for x in (CONTIGS_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES)]
    return f"""SELECT * FROM ({_with(*parts)} SELECT 21 AS kmer, 10 AS window, {most} AS max_frequency, count(*) AS unique_minimisers,
        coalesce(sum(frequency) FILTER (frequency <= {most}), 0)::BIGINT AS retained_observations, coalesce(sum(frequency * (frequency - 1) // 2) FILTER (frequency <= {most}), 0)::BIGINT AS pair_bound,
        (SELECT count(*) FROM candidates WHERE terminal_topologies <> '') AS candidates FROM freq)"""


ORACLE_SQL = {
    "sample_summary": _with(_READS, _SPANNING, _REPORTS)
    + """ SELECT *, testable_artificial_cases = artificial_cases AS baseline_established FROM (SELECT count(*) AS sample_cases, count(*) FILTER (ok) AS true_cases, count(*) FILTER (NOT ok) AS artificial_cases,
        count(*) FILTER (NOT ok AND remapped_reads > 0) AS testable_artificial_cases, count(*) FILTER (NOT ok AND spanning_reads > 0) AS false_support, count(*) FILTER (ok AND spanning_reads = 0) AS missed_support
        FROM truth JOIN judged USING (case_id))""",
    "case_statuses": _with(_READS, _SPANNING, _REPORTS)
    + """ SELECT case_id, status FROM (SELECT case_id, CASE WHEN ok AND most > 0 THEN 'detected_true' WHEN ok THEN 'missed_true' WHEN most > 0 THEN 'artificial_with_support' WHEN reads = 0 THEN 'untestable_artificial' END AS status
        FROM (SELECT case_id, ok, coalesce(max(spanning_reads), 0) AS most, coalesce(max(remapped_reads), 0) AS reads FROM truth LEFT JOIN judged USING (case_id) GROUP BY ALL)) WHERE status IS NOT NULL""",
    "parameter_sweep": f"{_swept(20)} UNION ALL {_swept(100)}",
    "graph_violations": _with(_LINE_HITS, _CLASSIFIED, _DECIDED, _ONE_WAY_EDGES, """damaged AS (
        SELECT edge_id, query_id, target_id, relationship_type, CASE WHEN query_id LIKE '%7' THEN 'overlap' ELSE kind END AS kind FROM edges UNION ALL
        SELECT edge_id, query_id, target_id, relationship_type, kind FROM edges WHERE query_id LIKE '%11')""")
    + """ SELECT edge_id AS id, 'incompatible kind or type' AS error FROM damaged WHERE NOT CASE kind WHEN 'containment' THEN relationship_type LIKE '%CONTAINED%' WHEN 'ambiguous' THEN relationship_type = 'AMBIGUOUS_OVERLAP' ELSE relationship_type LIKE '%SUFFIX_TO%' END
        UNION ALL SELECT DISTINCT edge_id, 'unknown sequence identifier' FROM damaged WHERE query_id LIKE '%13' OR target_id LIKE '%13'
        UNION ALL SELECT edge_id, 'repeated edge' FROM damaged GROUP BY edge_id HAVING count(*) > 1""",
    "pair_table": _with(_LINE_HITS, _CLASSIFIED, _DECIDED)
    + """ SELECT d.query_id AS query, d.target_id AS target, d.relationship_type, d.orientation, printf('%.6f', d.identity) AS identity, d.aligned_length, d.query_start, d.query_end, d.target_start, d.target_end,
        printf('%.6f', r.qcov) AS query_coverage, printf('%.6f', r.tcov) AS target_coverage, d.status, d.accepted_hits, d.rejected_hits,
        array_to_string(list_sort(list_filter(list_distinct(list_concat(string_split(d.reasons, '; '), string_split(coalesce(g.rejections, ''), '; '))), lambda x: x <> '')), '; ') AS reasons
        FROM decided d JOIN grouped g ON g.query_id = d.query_id AND g.target_id = d.target_id JOIN ranked r ON r.query_id = d.query_id AND r.target_id = d.target_id AND r.place = 1""",
    "relationship_table": _with(_LINE_HITS, _CLASSIFIED, _DECIDED)
    + " SELECT query_id AS query, target_id AS target, relationship_type, orientation, printf('%.6f', identity) AS identity, aligned_length, status, reasons FROM decided",
    "join_support": _with(ALTERED_SQL, *_TILE_RUN[1:])
    + """ SELECT 'unknown' AS component_id, edge_id, query_id AS left_contig, target_id AS right_contig, '' AS technology, 0::INT AS samples_tested, 0::INT AS selected_reads, 0::INT AS remapped_reads,
        0::INT AS spanning_reads, 0.0::DOUBLE AS spanning_fraction, '' AS minimum_mapping_quality, '' AS minimum_flank, 'DEFERRED' AS junction_status, '' AS policy_id,
        'no approved junction policy; imperfect overlap retained' AS decision_reason FROM lapped WHERE edge_id NOT IN (SELECT edge_id FROM supported)""",
    "unexpected_pairs": _with(_LINE_HITS, _CLASSIFIED, _DECIDED)
    + """ SELECT query_id, target_id, relationship_type AS observed, orientation AS observed_orientation, relationship_type = 'AMBIGUOUS_OVERLAP' AS ambiguous,
        'ordered pair is absent from sparse truth table' AS reason FROM decided WHERE target_id LIKE '%5'""",
    "score_counts": _with(_LINE_HITS, _CLASSIFIED, _DECIDED, _SPARSE, f"""met AS (
        SELECT t.*, d.relationship_type AS seen, d.orientation AS seen_strand, put_off <> '' AS deferred, coalesce(d.relationship_type = expected, false) AS same, coalesce(d.relationship_type = 'AMBIGUOUS_OVERLAP', false) AS vague,
               coalesce(d.relationship_type IN ({_TYPES}), false) AS merges
        FROM truth t LEFT JOIN decided d USING (query_id, target_id)
      ), judged AS (
        SELECT *, NOT deferred AND same AND (expected = 'NO_RELATIONSHIP' OR strand = seen_strand) AS correct FROM met)""")
    + f""" SELECT measure, NULL::VARCHAR AS relationship_type, n FROM (
        SELECT count(*) AS truth, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT deferred AND NOT allowed AND merges) AS false_merge,
          count(*) FILTER (expected IN ({_TYPES}) AND (seen IS NULL OR seen = 'NO_RELATIONSHIP')) AS missed, count(*) FILTER (NOT deferred AND NOT vague AND seen IS NOT NULL AND NOT same) AS wrong_type,
          count(*) FILTER (NOT deferred AND NOT vague AND same AND expected <> 'NO_RELATIONSHIP' AND strand <> seen_strand) AS wrong_orientation, count(*) FILTER (deferred) AS deferred,
          count(*) FILTER (NOT correct AND NOT deferred) AS boundary_failure, count(*) FILTER (seen IS NULL) AS absent, count(*) FILTER (vague AND NOT deferred) AS ambiguous,
          count(DISTINCT CASE WHEN deferred THEN put_off END) AS ambiguity_groups, (SELECT count(*) FROM decided) AS observed, (SELECT count(*) FROM decided WHERE target_id LIKE '%5') AS unexpected
        FROM judged) UNPIVOT (n FOR measure IN (truth, correct, false_merge, missed, wrong_type, wrong_orientation, deferred, boundary_failure, absent, ambiguous, ambiguity_groups, observed, unexpected))
      UNION ALL SELECT 'correct_of_type', expected, count(*) FROM judged WHERE correct GROUP BY 2 UNION ALL SELECT 'observed_of_type', relationship_type, count(*) FROM decided GROUP BY 2""",
    "pipeline_recall": _with(CONTIGS_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES, """truth AS (
        SELECT a.catalogue_id AS q, b.catalogue_id AS t, 'case' || a.original_identifier::BIGINT % 50 AS case_id, a.original_identifier::BIGINT % 7 = 0 AS exact
        FROM members a JOIN members b ON b.original_identifier::BIGINT = a.original_identifier::BIGINT + 1
        UNION ALL SELECT catalogue_id, catalogue_id, 'copies', true FROM members WHERE place > 1
      ), judged AS (
        SELECT t.*, c.query_id IS NOT NULL AS hit FROM truth t LEFT JOIN (SELECT query_id, target_id FROM candidates WHERE terminal_topologies <> '') c ON c.query_id = least(q, t) AND c.target_id = greatest(q, t))""")
    + """ SELECT count(*) FILTER (exact) AS exact_rows, count(*) FILTER (exact AND q = t) AS exact_recovered, count(*) FILTER (NOT exact) AS rows, count(*) FILTER (NOT exact AND hit) AS recalled_rows,
        count(*) FILTER (NOT exact AND NOT hit) AS missed_rows, count(DISTINCT CASE WHEN NOT exact THEN case_id END) AS groups, count(DISTINCT CASE WHEN NOT exact AND hit THEN case_id END) AS recalled_groups FROM judged""",
    "reads_near_end": _with(_READS, """lengths AS (SELECT 'ref' || i AS reference, 800 + 5 * i AS length FROM range(40) t(i)
      ), ends AS (SELECT reads.*, pos + span AS stop, length FROM reads JOIN (VALUES (0, 120), (1, 110), (2, 110), (3, 90), (4, 300)) s(shape, span) USING (shape) JOIN lengths USING (reference))""")
    + """ SELECT DISTINCT reference, 'left' AS side, name FROM ends WHERE pos < 100 AND stop > 0
        UNION SELECT DISTINCT reference, 'right', name FROM ends WHERE pos < length AND stop > length - 100""",
    "seq_reverse_complement": _with(CONTIGS_SQL) + f" SELECT identifier, md5({_RC.format('sequence')}) AS reversed_md5, length(sequence)::INT AS length FROM contigs",
    "seq_canonical_digest": _with(CONTIGS_SQL, _MEMBERS) + " SELECT identifier, sha256(canon) AS digest, orientation FROM members",
    "catalogue_sequences": _with(CONTIGS_SQL, _MEMBERS)
    + " SELECT catalogue_id, length(canon)::INT AS length, sha256(canon) AS sha256, identifier AS representative_source_id, group_size AS members FROM members WHERE place = 1",
    "catalogue_members": _with(CONTIGS_SQL, _MEMBERS) + " SELECT catalogue_id, identifier AS source_id, orientation, place = 1 AS representative FROM members",
    "catalogue_provenance": _with(CONTIGS_SQL, _MEMBERS)
    + """ SELECT catalogue_id AS output_sequence, source_sample, original_identifier AS source_contig, CASE WHEN group_size > 1 THEN 'EXACT_MATCH' ELSE 'UNIQUE' END AS relationship, orientation,
        0 AS source_start, length(canon)::INT AS source_end, 0 AS output_start, length(canon)::INT AS output_end, 1.0::DOUBLE AS identity,
        CASE WHEN place = 1 THEN 'representative' ELSE 'exact_duplicate' END AS disposition, 'canonical exact sequence catalogue' AS decision_reason, 'none' AS evidence_mode FROM members""",
    "sample_totals": _with(CONTIGS_SQL) + " SELECT source_sample, count(*) AS contigs, sum(length(sequence))::BIGINT AS bases FROM contigs GROUP BY 1",
    "minimiser_observations": _with(CONTIGS_SQL, _MEMBERS, _SEEDS) + " SELECT sequence_id, value, position::INT AS position, orientation FROM obs",
    "minimiser_frequency": _with(CONTIGS_SQL, _MEMBERS, _SEEDS) + " SELECT * FROM freq",
    "seed_pair_bound": _with(CONTIGS_SQL, _MEMBERS, _SEEDS)
    + """ SELECT count(*) AS unique_minimisers, coalesce(sum(frequency) FILTER (frequency <= 100), 0)::BIGINT AS retained_observations,
        coalesce(sum(frequency * (frequency - 1) // 2) FILTER (frequency <= 100), 0)::BIGINT AS pair_bound FROM freq""",
    "pair_evidence": _with(CONTIGS_SQL, _MEMBERS, _SEEDS, _PAIRS)
    + """ SELECT query_id, target_id, count(DISTINCT kmer) AS shared_minimisers, count(DISTINCT qp) AS query_positions, count(DISTINCT tp) AS target_positions, count(*) AS evidence
        FROM pairs GROUP BY query_id, target_id""",
    "candidate_pairs": _with(CONTIGS_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES) + " SELECT * FROM candidates WHERE terminal_topologies <> ''",
    "hit_metrics": _with(_LINE_HITS, _CLASSIFIED)
    + """ SELECT query_id, target_id, count(*) AS hits, max(identity) AS best_identity, min(qcov) AS least_query_coverage, max(tcov) AS most_target_coverage, sum(qed)::BIGINT AS end_distance
        FROM measured GROUP BY query_id, target_id""",
    "hit_violations": _with(_LINE_HITS)
    + """ SELECT violations, count(*) AS hits FROM (SELECT array_to_string(list_filter([
        CASE WHEN query_start < 0 OR query_end < query_start OR query_end > query_length THEN 'query interval' END,
        CASE WHEN target_start < 0 OR target_end < target_start OR target_end > target_length THEN 'target interval' END,
        CASE WHEN matching_bases < 0 OR matching_bases > least(query_end - query_start, target_end - target_start) THEN 'matching bases' END,
        CASE WHEN alignment_block_length < greatest(query_end - query_start, target_end - target_start) OR alignment_block_length > query_end - query_start + target_end - target_start THEN 'block length' END,
        CASE WHEN mapping_quality < 0 OR mapping_quality > 255 THEN 'mapping quality' END], lambda x: x IS NOT NULL), ',') AS violations
        FROM (SELECT * REPLACE (CASE WHEN mapping_quality = 56 THEN query_length + 1 ELSE query_end END AS query_end,
                                CASE WHEN mapping_quality = 48 THEN alignment_block_length + 1 ELSE matching_bases END AS matching_bases) FROM hits)) WHERE violations <> '' GROUP BY 1""",
    "classify_hits": _with(_LINE_HITS, _CLASSIFIED) + " SELECT relationship_type, status, reason, count(*) AS hits FROM classified GROUP BY ALL",
    "classify_pairs": _with(_LINE_HITS, _CLASSIFIED, _DECIDED)
    + " SELECT query_id, target_id, relationship_type, orientation, identity, aligned_length, status, reasons, accepted_hits, rejected_hits FROM decided",
    "relationship_histogram": _with(_LINE_HITS, _CLASSIFIED, _DECIDED) + " SELECT relationship_type, status, count(*) AS pairs FROM decided GROUP BY ALL",
    "graph_edges": _with(_LINE_HITS, _CLASSIFIED, _DECIDED, _ONE_WAY_EDGES)
    + """ SELECT edge_id, kind, query_id, target_id, relationship_type, orientation, aligned_length, CASE WHEN kind <> 'ambiguous' THEN query_start END AS query_start,
        CASE WHEN kind <> 'ambiguous' THEN target_end END AS target_end, CASE WHEN kind = 'ambiguous' THEN 'pair classifier retained ambiguous alignment evidence' ELSE '' END AS ambiguity_reasons FROM edges""",
    "graph_components": _with(*_LINE_GRAPH) + " SELECT n AS node, component_id, members FROM labels",
    "relationship_components": _with(*_LINE_GRAPH) + " SELECT * FROM components",
    "document_hits": _with(*_TILE_HITS) + _HIT_COLUMNS,
    "document_relationships": _with(*_TILE_HITS, _CLASSIFIED, _DECIDED) + " SELECT relationship_type, status, count(*) AS pairs FROM decided GROUP BY ALL",
    "component_ambiguity": _with(*_TILE_GRAPH) + " SELECT * FROM components",
    "containment_decisions": _with(*_PIECE_RUN)
    + """ SELECT edge_id, child, parent, CASE WHEN len(why) = 0 THEN 'eligible' ELSE 'deferred' END AS status,
        CASE WHEN len(why) = 0 THEN 'unique containment creates no new sequence junction' ELSE array_to_string(why, '; ') END AS reasons FROM contained""",
    "overlap_decisions": _with(*_TILE_RUN)
    + """ SELECT component_id, overlap_edges, unsupported, CASE WHEN len(why) = 0 THEN 'eligible' ELSE 'deferred' END AS status,
        CASE WHEN len(why) = 0 THEN 'all junctions are supported in an unambiguous overlap-only component' ELSE array_to_string(why, '; ') END AS reasons FROM decisions""",
    "linear_paths": _with(*_TILE_RUN) + " SELECT path_id, component_id, step, node AS sequence_id, strand, edge_id FROM paths",
    "merged_sequences": _with(*_TILE_RUN) + " SELECT output_sequence, length, sequence_md5, description FROM outputs",
    "merge_provenance": _with(*_TILE_RUN) + " SELECT * FROM provenance",
    "ambiguity_report": _with(*_JOINT_RUN) + " SELECT * FROM reports",
    "joint_components": _with(*_JOINT_RUN) + " SELECT * FROM components",
    "contained_provenance": _with(*_PIECE_RUN) + " SELECT * FROM provenance",
    "contained_stats": _with(*_PIECE_RUN) + _STATS,
    "merge_stats": _with(*_TILE_RUN) + _STATS,
    "cigar_blocks": _with(_READS)
    + " SELECT reference, count(*) AS blocks, sum(stop - start)::BIGINT AS aligned, min(start)::INT AS first, max(stop)::INT AS last FROM blocks GROUP BY reference",
    "junction_spanning": _with(_READS, _SPANNING) + " SELECT case_id, remapped_reads, spanning_reads FROM spanning",
    "junction_support": _with(_READS, _SPANNING)
    + """ SELECT case_id, remapped_reads, spanning_reads, CASE WHEN length(case_id) = 5 THEN 'deferred' WHEN spanning_reads >= 3 AND fraction >= 0.1 THEN 'supported' ELSE 'unsupported' END AS status,
        CASE WHEN length(case_id) = 5 THEN 'technology or preset differs from the policy' WHEN spanning_reads >= 3 AND fraction >= 0.1 THEN 'reads and fraction reach the policy'
             ELSE 'reads or fraction below the policy' END AS reason FROM rated""",
    "policy_threshold_sweep": _with(_READS, _SPANNING)
    + """ SELECT minimum_reads, minimum_fraction, count(*) FILTER (good) AS supported, count(*) FILTER (is_true AND NOT good) AS missed, count(*) FILTER (NOT is_true AND good) AS false_support
        FROM (SELECT *, length(case_id) = 6 AS is_true, spanning_reads >= minimum_reads AND fraction >= minimum_fraction AS good
              FROM rated CROSS JOIN (VALUES (1::INT, 0.0::DOUBLE), (3, 0.1::DOUBLE), (5, 0.5::DOUBLE)) v(minimum_reads, minimum_fraction)) GROUP BY ALL""",
    "benchmark_summary": _with(_LINE_HITS, _CLASSIFIED, _DECIDED, """scored AS (
        SELECT *, NOT query_id LIKE '%1' AS allowed, target_id LIKE '%3' AS put_off, relationship_type IN ('EXACT_MATCH','QUERY_CONTAINED_IN_TARGET','TARGET_CONTAINED_IN_QUERY','QUERY_SUFFIX_TO_TARGET_PREFIX','TARGET_SUFFIX_TO_QUERY_PREFIX') AS merges,
               relationship_type = 'AMBIGUOUS_OVERLAP' AS vague, relationship_type = 'NO_RELATIONSHIP' AS none, NOT target_id LIKE '%2' OR orientation = '+' AS strand_ok FROM decided
      ), judged AS (SELECT *, allowed OR none AS same, NOT put_off AND (allowed OR none) AND (NOT allowed OR none OR strand_ok) AS correct FROM scored)""")
    + """ SELECT count(*) AS cases, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT put_off AND NOT allowed AND merges) AS false_merge, 0::BIGINT AS missed,
        count(*) FILTER (NOT put_off AND NOT vague AND NOT same) AS wrong_type, count(*) FILTER (NOT put_off AND NOT vague AND allowed AND NOT none AND NOT strand_ok) AS wrong_orientation,
        count(*) FILTER (put_off) AS deferred, count(*) FILTER (NOT correct AND NOT put_off) AS boundary_failure FROM judged""",
    "diagonal_hits": _with(*_WHOLE_HITS) + _HIT_COLUMNS,
    "aligned_relationships": _with(*_WHOLE_HITS, _CLASSIFIED, _DECIDED)
    + " SELECT query_id, target_id, relationship_type, orientation, identity, aligned_length, status, reasons, accepted_hits, rejected_hits FROM decided",
    "circular_slices": _with(CONTIGS_SQL)
    + f""", cut AS (SELECT identifier, length(sequence) AS n, (2 * length(sequence)) // 3 AS a, length(sequence) // 4 AS e, sequence || sequence AS twice FROM contigs WHERE length(sequence) > 0
      ), part AS (SELECT identifier, n, substr(twice, a + 1, CASE WHEN e > a THEN e ELSE e + n END - a) AS p FROM cut)
      SELECT identifier, md5(CASE WHEN n % 2 = 0 THEN p ELSE {_RC.format('p')} END) AS slice_md5, length(p)::INT AS slice_length FROM part""",
    "read_partitions": _with(_READS) + " SELECT DISTINCT name, (('0x' || substr(sha256('17' || chr(0) || name), 1, 16))::UBIGINT % 3)::INT AS part FROM reads",
    "alignment_batches": _with(_LINE_HITS)
    + """ SELECT query_id, target_id, 0::BIGINT AS part, ((row_number() OVER (PARTITION BY target_id ORDER BY query_id) - 1) // 20)::BIGINT AS batch
        FROM (SELECT DISTINCT query_id, target_id FROM hits)""",
    "unplanned_hits": _with(_LINE_HITS)
    + """ SELECT query_id, count(*) AS hits FROM hits h
        WHERE NOT EXISTS (SELECT 1 FROM hits p WHERE p.mapping_quality >= 16 AND p.query_id = h.query_id AND p.target_id = h.target_id) GROUP BY query_id""",
    "pileup_decode": """WITH shown(k, seen) AS (VALUES (0, 'rrrA'), (1, 'G*rr'), (2, 'T'), (3, 'rrN'), (4, '')
      ), places AS (SELECT substr('ACGT', (event_id % 4 + 1)::INT, 1) AS ref, replace(seen, 'r', substr('ACGT', (event_id % 4 + 1)::INT, 1)) AS seen,
           CASE WHEN event_id % 2 = 0 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS q FROM events JOIN shown ON k = event_id % 5
      ), told AS (SELECT *, length(seen)::BIGINT AS depth,
           array_to_string(list_filter(list_transform(['*', 'A', 'C', 'G', 'N', 'T'], lambda a: a || ':' || (length(seen) - length(replace(seen, a, '')))), lambda x: NOT ends_with(x, ':0')), ',') AS alleles
           FROM places)
      SELECT ref, depth, alleles, count(*) AS places, sum(CASE WHEN depth > 0 THEN q END) AS quality FROM told GROUP BY ALL""",
    "extracted_reads": _with(_READS) + " SELECT reference, count(*) AS records FROM reads WHERE name IN (SELECT name FROM reads WHERE pos < 30) GROUP BY reference",
    "junction_scores": _with(_READS, _SPANNING)
    + """, told AS (SELECT case_id, CASE WHEN length(case_id) = 5 THEN 'deferred' WHEN spanning_reads >= 3 AND fraction >= 0.1 THEN 'supported' ELSE 'unsupported' END AS status FROM rated
      ), met AS (SELECT i % 3 > 0 AS ok, coalesce(status, 'deferred') AS status FROM range(45) t(i) LEFT JOIN told ON case_id = 'case' || i)
      SELECT count(*) AS cases, count(*) FILTER (ok AND status = 'supported') AS true_supported, count(*) FILTER (NOT ok AND status = 'supported') AS false_supported,
        count(*) FILTER (ok AND status = 'unsupported') AS true_missed, count(*) FILTER (NOT ok AND status = 'unsupported') AS false_rejected, count(*) FILTER (status = 'deferred') AS deferred FROM met""",
}

from .datasets import SQL as _DATASETS  # noqa: E402
from .junctions import SQL as _JUNCTIONS  # noqa: E402
from .pileups import SQL as _PILEUPS  # noqa: E402

ORACLE_SQL |= {**_JUNCTIONS, **_PILEUPS, **_DATASETS}

#: ``inputs.unfolded_hits`` that pass the checks of a PAF line.
_PAF_HITS = f"""raw AS ({UNFOLDED_HITS_SQL.replace("AS STRING", "AS VARCHAR")}), checked AS (
  SELECT *, CASE
    WHEN query_start < 0 OR query_end < query_start OR query_end > query_length OR target_start < 0 OR target_end < target_start OR target_end > target_length THEN 'an interval is out of range'
    WHEN mapping_quality < 0 OR mapping_quality > 255 THEN 'mapping quality'
    WHEN alignment_block_length < 0 OR matching_bases < 0 OR matching_bases > alignment_block_length THEN 'matching bases and block length'
    WHEN matching_bases > least(query_end - query_start, target_end - target_start) THEN 'more matching bases than an aligned span'
    WHEN alignment_block_length < greatest(query_end - query_start, target_end - target_start) THEN 'a block shorter than an aligned span'
    WHEN alignment_block_length > query_end - query_start + target_end - target_start THEN 'a block longer than both aligned spans' END AS error
  FROM raw
), hits AS (SELECT * EXCLUDE (error) FROM checked WHERE error IS NULL)"""

ORACLE_SQL |= {
    "paf_score_counts": ORACLE_SQL["score_counts"].replace(_LINE_HITS, _PAF_HITS),
    "paf_errors": f"""WITH {_PAF_HITS} SELECT error, count(*) AS lines FROM (
      SELECT error FROM checked UNION ALL SELECT error FROM checked WHERE mapping_quality = 56 UNION ALL SELECT 'fewer than twelve fields' FROM checked WHERE mapping_quality = 48) WHERE error IS NOT NULL GROUP BY error""",
}

_KINDS = ("EXACT_MATCH", "QUERY_CONTAINED_IN_TARGET", "TARGET_CONTAINED_IN_QUERY", "QUERY_SUFFIX_TO_TARGET_PREFIX", "TARGET_SUFFIX_TO_QUERY_PREFIX", "AMBIGUOUS_OVERLAP", "NO_RELATIONSHIP")


def _measures(stage: str, source: str, measures: dict[str, str]) -> str:
    """A row a measure of one stage."""
    listed = ", ".join(f"{{'measure': '{name}', 'value': coalesce(({value})::DOUBLE, 0)}}" for name, value in measures.items())
    return f"SELECT '{stage}' AS stage, m.measure, m.value FROM (SELECT unnest([{listed}]) AS m FROM {source})"


def _statistics() -> str:
    lengths = {"rows": "count(*)", "bases": "sum(len)", "mean": "avg(len)", "median": "quantile_cont(len, 0.5)", "shortest": "min(len)", "longest": "max(len)", "empty": "count(*) FILTER (len = 0)"}
    lengths |= {f"from_{1 << k}_below_{2 << k}": f"count(*) FILTER (len >= {1 << k} AND len < {2 << k})" for k in range(24)}
    kept = "FILTER (frequency <= 100)"
    seeds = {"unique_minimisers": "count(*)", "observations": "sum(frequency)", "discarded_minimisers": "count(*) FILTER (frequency > 100)", "retained_observations": f"sum(frequency) {kept}", "pair_bound": f"sum(frequency * (frequency - 1) // 2) {kept}", "most_frequent": "max(frequency)"}
    strands = {f"orientation_{s}": f"count(*) FILTER (orientation = '{s}')" for s in "+-"}
    shared = {"pairs": "count(*)", "median_shared": "quantile_cont(shared_minimisers, 0.5)", "most_shared": "max(shared_minimisers)"}
    kinds = {f"relationship_type_{k}": f"count(*) FILTER (relationship_type = '{k}')" for k in _KINDS}
    parts = [
        _measures("catalogue", "seqs", lengths), _measures("seeds", "(SELECT value, kmer, count(*) AS frequency FROM obs GROUP BY value, kmer)", seeds),
        _measures("candidates", "candidates WHERE terminal_topologies <> ''", shared | strands),
        _measures("members", "members", {"sources": "count(*)", "duplicates_collapsed": "count(*) FILTER (place > 1)"} | strands), _measures("decisions", "decided", {"pairs": "count(*)"} | kinds),
    ]
    return _with(*_TILE_HITS, _CLASSIFIED, _DECIDED) + " " + " UNION ALL ".join(parts)


ORACLE_SQL |= {"run_statistics": _statistics()}


def _gridded(kmer: int, window: int, most: int) -> str:
    """``_swept`` with another k and w."""
    text = _swept(most)
    for old, new in (
        (", 21)", f", {kmer})"), ("len - 20", f"len - {kmer - 1}"), ("len >= 21", f"len >= {kmer}"), ("least(10,", f"least({window},"), ("9 PRECEDING", f"{window - 1} PRECEDING"), ("9 FOLLOWING", f"{window - 1} FOLLOWING"),
        ("qp + 21", f"qp + {kmer}"), ("tp + 21", f"tp + {kmer}"), ("21 AS kmer", f"{kmer} AS kmer"), ("10 AS window", f"{window} AS window"),
    ):
        if old not in text:
            raise ValueError(f"the sweep has no {old}")
        text = text.replace(old, new)
    return f"SELECT * FROM ({text})"


_UNFOLDED = f"hits AS ({UNFOLDED_HITS_SQL.replace('AS STRING', 'AS VARCHAR')})"

ORACLE_SQL |= {
    "parameter_grid": " UNION ALL ".join(_gridded(k, w, f) for k in (15, 21) for w in (5, 10) for f in (20, 100)),
    "hit_decisions": _with(_UNFOLDED, _CLASSIFIED) + " SELECT query_id, target_id, orientation, query_start, query_end, target_start, target_end, matching_bases, alignment_block_length, relationship_type, status, reason FROM classified",
    "pair_decisions": ORACLE_SQL["classify_pairs"].replace(_LINE_HITS, _UNFOLDED),
}

ORACLE_SQL |= {
    "candidate_table": _with(TILES_SQL, _MEMBERS, _SEEDS, _PAIRS, _CANDIDATES, """places AS (
      SELECT query_id, target_id, string_agg(DISTINCT qp, ',' ORDER BY qp) AS query_positions, string_agg(DISTINCT tp, ',' ORDER BY tp) AS target_positions FROM pairs GROUP BY query_id, target_id)""")
    + """ SELECT query_id AS query, target_id AS target, shared_minimisers, coalesce(orientation, '.') AS orientation, supported_orientations, query_positions, target_positions, terminal_topologies, reasons
      FROM candidates JOIN places USING (query_id, target_id) WHERE terminal_topologies <> ''""",
}
