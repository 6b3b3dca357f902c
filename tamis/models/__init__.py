"""Ready-made rule sets."""

from tamis.models import api, database, deployment, generic, github, incident
from tamis.plans.ruleset import RuleSet

# model type -> rule set, for records that carry their type
CATALOG: dict[str, RuleSet] = {
    "incident": incident.INCIDENT,
    "deployment": deployment.DEPLOYMENT,
    "generic": generic.GENERIC,
    "api": api.REQUEST,
    "database": database.QUERY,
    "github": github.PULL_REQUEST_EVENT,
}

# every declared structure by name
STRUCTURES: dict[str, RuleSet] = {
    rs.name: rs
    for module in (incident, deployment, generic, api, database, github)
    for rs in vars(module).values()
    if isinstance(rs, RuleSet)
}
