"""Deployment notices."""

from tamis.functions.scalars import contains_any
from tamis.plans.ruleset import Check, flag, required, rule_set, text, time

# fixed values: version words that do not belong into production
UNSTABLE_WORDS = ("dev", "test", "alpha")

DEPLOYMENT = rule_set(
    "DeploymentPayload",
    text("id", required, min=1, max=50),
    text("app_name", required, min=2, max=100, deployment_name=True),
    text("environment", required, oneof="development staging production"),
    text("version", required, loose_semver=True),
    text("status", required, oneof="pending running completed failed"),
    text("branch", required, min=1, max=200),
    text("commit_hash", required, len=40, hexadecimal=True),
    text("deployed_by", required, email=True),
    time("deployed_at", required),
    flag("rollback", boolean=True),
    checks=[
        Check(
            "NON_MAIN_PROD_DEPLOY",
            "$environment = 'production' AND $branch NOT IN ('main', 'master')",
            "branch",
            "Production deployment from '{$branch}' branch is not recommended",
            suggestion="Consider deploying production from main/master branch",
        ),
        Check(
            "ROLLBACK_DEPLOYMENT",
            "$rollback",
            "rollback",
            "This is a rollback deployment",
            suggestion="Ensure the target version is stable",
        ),
        Check(
            "FAILED_DEPLOYMENT",
            "$status = 'failed'",
            "status",
            "Deployment has failed status",
            suggestion="Check deployment logs and investigate failure cause",
        ),
        Check(
            "DEV_VERSION_IN_PROD",
            f"$environment = 'production' AND {contains_any('lower($version)', UNSTABLE_WORDS)}",
            "version",
            "Version '{$version}' appears to be a development/test version",
            suggestion="Ensure you're deploying a stable production version",
        ),
    ],
    title="DeploymentValidator",
    model_type="deployment",
    provider="deployment_validator",
    style="deployment",
)
