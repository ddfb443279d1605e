"""Enumerations and table schemas, as DDL."""

from __future__ import annotations

CATEGORIES = ("Evidence", "Fact", "Decision", "Hypothesis", "Goal", "Action", "Outcome")
EVIDENCE, FACT, DECISION, HYPOTHESIS, GOAL, ACTION, OUTCOME = range(7)
CHANNELS = ("Memory", "Technical")
CLASSIFICATIONS = ("Public", "Internal", "Confidential", "Secret", "Pii")
PRIVATE_CLASSES = (2, 3, 4)
CURATIONS = ("Amend", "Annotate", "Pin", "Demote", "Revert")
PRIVATE, SHARED, GLOBAL = range(3)
#: Order in which categories appear in bundles.
BUNDLE_ORDER = (DECISION, GOAL, HYPOTHESIS, FACT, ACTION, OUTCOME, EVIDENCE)

TRIPLE = "subject string, predicate string, object string"
PAYLOAD = "`$type` string, content string, source string, classification int, statement string, rationale string, supportingEvents array<string>, triples array<struct<subject:string,predicate:string,object:string>>, approver string, state int, decisionEvent string, externalReference string, actionEvent string, polarity int, name string, procedure string, trigger string"
#: Capture envelope as producers send it.
CAPTURE = "event_id string, workstream_id string, channel int, category int, valid_at timestamp_ntz, recorded_at timestamp_ntz, principal_id string, source string, payload string, schema_version int"
#: The append-only log.
LOG = "event_id string, workstream_id string, event_channel int, category int, schema_version int, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, expired_at timestamp_ntz, payload string, source string, content_shape int, classification int, principal_id string, artifact_id string"
REVOCATION = "event_id string, revoked_at timestamp_ntz"
VISIBILITY = "event_id string, visibility int"
#: Session entries and the offset watermark of a session.
ENTRY = "session_id string, entry_id string, entry_at timestamp_ntz, kind int, text string, speaker string"
WATERMARK = "session_id string, last_entry string"
EDGE = "edge_id string, workstream_id string, source_event string, target_event string, relation string, created_at timestamp_ntz"
