"""Logical tables as explicit schemas, in DDL; CSV and JSON are never inferred."""

FILE_INVENTORY = "relative_path string, patient_id string, recording_id string, sampling_rate_hz double, n_times bigint, duration_seconds double, n_channels int, ordered_signature string, unordered_signature string, file_size bigint, sha256 string"
CHANNEL_LONG = "relative_path string, recording_id string, channel_index int, original_name string, normalized_name string, base_name string"
SIGNAL_BLOCKS = "recording_id string, channel_index int, channel_name string, block_index bigint, start_sample bigint, sampling_rate_hz double, samples array<float>"
PARSED_RECORDINGS = "case_id string, recording_id string, edf_filename string, start_clock string, end_clock string, duration_seconds bigint, crosses_midnight boolean, n_seizures int"
PARSED_SEIZURES = "case_id string, recording_id string, edf_filename string, seizure_index int, onset_seconds double, offset_seconds double, duration_seconds double"
PARSE_PROBLEMS = "path string, error_type string, error_message string"
ALIAS_RULES = "rule_order int, original_name string, normalized_name string, canonical_name string, alias_type string, validation_status string, scope string, recording_id string"
WINDOW_MANIFEST = "window_id string, recording_id string, window_index bigint, start_sample bigint, stop_sample_exclusive bigint, label_name string, label_id int, binary_label int"
SUBJECT_MAPPING = "case_id string, subject_id string, mapping_status string, mapping_source string, notes string"
FAILURES = "item string, error_type string, error_message string"
