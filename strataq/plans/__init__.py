"""Named queries; importing the modules registers them."""

from strataq.plans import findings, graph, history, joins, narrative, search, sections, session, streams, trends, validation, verdict  # noqa: F401
