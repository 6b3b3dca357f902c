"""Pull-request events and the commit structures around them."""

from tamis.functions.scalars import WordBits, hours_between, ratio
from tamis.functions.text import count_of
from tamis.plans.ruleset import (
    Check, RuleSet, anything, deep, flag, integer, optional, record, records, required, rule_set, text, texts, time,
)

# fixed values: word lists, all lower case
WIP_MARKS = [
    "wip:", "[wip]", "work in progress", "do not merge", "dnm:", "[dnm]", "draft:", "[draft]", "temporary", "temp:",
    "fixup!", "squash!",
]
TEMPLATE_SECTIONS = ("summary", "changes", "testing", "checklist")
SECURITY_WORDS = (
    "password", "secret", "key", "token", "credential", "auth", "security", "vulnerability", "exploit", "backdoor",
    "hardcode", "api_key", "private_key", "access_token", "secret_key",
)
CONFIG_WORDS = ("dockerfile", "docker-compose", ".env", "config")

USER = rule_set(
    "User",
    text("login", required, github_username=True),
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    text("avatar_url", required, url=True),
    text("gravatar_id", nullable=True),
    *[text(n, required, url=True) for n in
      "url html_url followers_url following_url gists_url starred_url subscriptions_url organizations_url repos_url"
      " events_url received_events_url".split()],
    text("type", required, oneof="User Organization Bot"),
    flag("site_admin"),
    text("name", optional, nullable=True, min=1, max=255),
    text("company", optional, nullable=True, max=255),
    text("blog", optional, nullable=True, url=True),
    text("location", optional, nullable=True, max=255),
    text("email", optional, nullable=True, email=True),
    text("bio", optional, nullable=True, max=160),
    text("twitter_username", optional, nullable=True, max=15),
    integer("public_repos", optional, nullable=True, gte=0),
    integer("public_gists", optional, nullable=True, gte=0),
    integer("followers", optional, nullable=True, gte=0),
    integer("following", optional, nullable=True, gte=0),
    time("created_at", optional, nullable=True),
    time("updated_at", optional, nullable=True),
    style="github",
)
REPOSITORY = rule_set(
    "Repository",
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    text("name", required, min=1, max=100),
    text("full_name", required, min=1, max=200),
    flag("private"),
    record("owner", USER, required),
    text("html_url", required, url=True),
    text("description", optional, nullable=True, max=350),
    flag("fork"),
    text("url", required, url=True),
    time("created_at", required),
    time("updated_at", required),
    time("pushed_at", required),
    text("git_url", required, url=True),
    text("ssh_url", required, min=1),
    text("clone_url", required, url=True),
    text("homepage", optional, nullable=True, url=True),
    integer("size", gte=0),
    integer("stargazers_count", gte=0),
    integer("watchers_count", gte=0),
    text("language", optional, nullable=True, min=1, max=50),
    flag("has_issues"),
    flag("has_projects"),
    flag("has_wiki"),
    flag("has_pages"),
    integer("forks_count", gte=0),
    integer("open_issues_count", gte=0),
    integer("forks", gte=0),
    integer("open_issues", gte=0),
    integer("watchers", gte=0),
    text("default_branch", required, min=1, max=255),
    texts("topics", optional, each=dict(min=1, max=50)),
    text("visibility", required, oneof="public private internal"),
    flag("allow_squash_merge"),
    flag("allow_merge_commit"),
    flag("allow_rebase_merge"),
    flag("delete_branch_on_merge"),
    style="github",
)
REFERENCE = rule_set(
    "Reference",
    text("label", required, min=1),
    text("ref", required, min=1),
    text("sha", required, len=40, hexadecimal=True),
    record("user", USER, required),
    record("repo", REPOSITORY, required),
    style="github",
)
LABEL = rule_set(
    "Label",
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    text("url", required, url=True),
    text("name", required, min=1, max=50),
    text("color", required, hexcolor=True),
    flag("default"),
    text("description", optional, nullable=True, max=100),
    style="github",
)


TEAM_STEP = rule_set(
    "Team",
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    text("url", required, url=True),
    text("html_url", required, url=True),
    text("name", required, min=1, max=255),
    text("slug", required, min=1, max=255),
    text("description", optional, nullable=True, max=255),
    text("privacy", required, oneof="closed secret"),
    text("permission", required, oneof="pull push admin maintain triage"),
    text("members_url", required, url=True),
    text("repositories_url", required, url=True),
    style="github",
)


def team(levels: int = 1) -> RuleSet:
    """A team; parent teams nest to any depth, of which ``levels`` are unrolled into structs."""
    parent = (record("parent", team(levels - 1), optional, nullable=True) if levels
              else deep("parent", TEAM_STEP, len(TEAM_STEP.fields)))
    return TEAM_STEP.with_(name=f"Team{levels}", fields=(*TEAM_STEP.fields, parent))


TEAM = team().with_(name="Team")
MILESTONE = rule_set(
    "Milestone",
    text("url", required, url=True),
    text("html_url", required, url=True),
    text("labels_url", required, url=True),
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    integer("number", required, gt=0),
    text("state", required, oneof="open closed"),
    text("title", required, min=1, max=255),
    text("description", optional, nullable=True, max=1000),
    record("creator", USER, required),
    integer("open_issues", gte=0),
    integer("closed_issues", gte=0),
    time("created_at", required),
    time("updated_at", required, gtefield="created_at"),
    time("closed_at", optional, nullable=True),
    time("due_on", optional, nullable=True),
    style="github",
)
PULL_REQUEST = rule_set(
    "PullRequest",
    integer("id", required, gt=0),
    text("node_id", required, min=1),
    integer("number", required, gt=0),
    text("state", required, oneof="open closed merged"),
    flag("locked"),
    text("title", required, min=1, max=256),
    text("body", optional, nullable=True, max=65536),
    time("created_at", required),
    time("updated_at", required, gtefield="created_at"),
    time("closed_at", optional, nullable=True),
    time("merged_at", optional, nullable=True),
    text("merge_commit_sha", optional, nullable=True, len=40, hexadecimal=True),
    record("assignee", USER, optional, nullable=True),
    records("assignees", USER, optional),
    records("requested_reviewers", USER, optional),
    records("requested_teams", TEAM, optional),
    records("labels", LABEL, optional),
    record("milestone", MILESTONE, optional, nullable=True),
    flag("draft"),
    text("commits_url", required, url=True),
    text("review_comments_url", required, url=True),
    text("comments_url", required, url=True),
    text("statuses_url", required, url=True),
    record("head", REFERENCE, required),
    record("base", REFERENCE, required),
    record("user", USER, required),
    flag("mergeable", nullable=True),
    flag("rebaseable", nullable=True),
    text("mergeable_state", optional, oneof="clean unstable dirty unknown blocked behind draft"),
    record("merged_by", USER, optional, nullable=True),
    integer("comments", gte=0),
    integer("review_comments", gte=0),
    flag("maintainer_can_modify"),
    integer("commits", required, gt=0),
    integer("additions", gte=0),
    integer("deletions", gte=0),
    integer("changed_files", gte=0),
    style="github",
)
INSTALLATION = rule_set(
    "Installation", integer("id", required, gt=0), text("node_id", required, min=1), style="github",
)

_TITLE = WordBits("title_words", "lower($pull_request.title)", WIP_MARKS, CONFIG_WORDS, ["wip", "draft"])
_BODY = WordBits("body_words", "lower(coalesce($pull_request.body, ''))", TEMPLATE_SECTIONS)
_CHANGES = "($pull_request.additions + $pull_request.deletions)"
_SHORT = "($pull_request.body IS NULL OR octet_length($pull_request.body) < 10)"
_BOTH = WordBits("both_words", "lower(concat($pull_request.title, '\\n', coalesce($pull_request.body, '')))", SECURITY_WORDS)
_AGE = hours_between("$pull_request.created_at", "$now")

PULL_REQUEST_EVENT = rule_set(
    "GitHubPayload",
    text("action", required, oneof="opened closed reopened synchronize"),
    integer("number", required, gt=0),
    record("pull_request", PULL_REQUEST, required),
    record("repository", REPOSITORY, required),
    record("sender", USER, required),
    record("organization", USER, optional, nullable=True),
    record("installation", INSTALLATION, optional, nullable=True),
    lets={**_TITLE.let, **_BODY.let, **_BOTH.let},
    checks=[
        Check("WIP_DETECTED", _TITLE.any(WIP_MARKS), "PullRequest.Title",
              "Pull request title contains WIP indicator: '{" + _TITLE.first(WIP_MARKS) + "}'",
              "$pull_request.title", "Consider marking as draft or updating title when ready for review", "workflow"),
        Check("DRAFT_TITLE_MISMATCH", f"$pull_request.draft AND NOT {_TITLE.any(['wip', 'draft'])}",
              "PullRequest.Draft", "Pull request is marked as draft but title doesn't indicate WIP status", None,
              "Consider adding WIP or Draft indicator to title for clarity", "workflow"),
        Check("LARGE_CHANGESET", f"{_CHANGES} > 1000", "PullRequest.Changes",
              "Large changeset detected: {" + _CHANGES + "} total changes across {$pull_request.changed_files} files"
              " (severity: {if(" + _CHANGES + " > 5000, 'high', 'warning')})", _CHANGES,
              "Consider breaking large changes into smaller, focused pull requests", "maintainability"),
        Check("MANY_FILES_CHANGED", "$pull_request.changed_files > 50", "PullRequest.ChangedFiles",
              "Many files changed: {$pull_request.changed_files} files modified", "$pull_request.changed_files",
              "Consider splitting changes across multiple focused pull requests", "maintainability"),
        Check("HIGH_DELETION_RATIO", f"{_CHANGES} > 0 AND {ratio('$pull_request.deletions', _CHANGES)} > 0.7D",
              "PullRequest.Deletions", "High deletion ratio detected - this appears to be a major refactoring",
              ratio("$pull_request.deletions", _CHANGES),
              "Ensure thorough testing and consider gradual rollout for major refactors", "risk-assessment"),
        Check("MISSING_DESCRIPTION", _SHORT, "PullRequest.Body", "Pull request description is missing or too short",
              None, "Add a detailed description explaining the changes, motivation, and testing approach",
              "documentation"),
        Check("INCOMPLETE_TEMPLATE", f"NOT {_SHORT} AND {_BODY.count(TEMPLATE_SECTIONS, missing=True)} > 2",
              "PullRequest.Body",
              "PR description may be missing standard sections: {"
              + _BODY.all(TEMPLATE_SECTIONS, missing=True) + "}", None,
              "Consider using the PR template to ensure all necessary information is provided", "documentation"),
        Check("SECURITY_KEYWORDS", _BOTH.any(SECURITY_WORDS), "PullRequest.Content",
              "Security-related keywords detected: {" + _BOTH.all(SECURITY_WORDS) + "}", None,
              "Ensure no sensitive information is exposed and consider security review", "security"),
        Check("CONFIG_FILE_CHANGES", f"$pull_request.changed_files > 0 AND {_TITLE.any(CONFIG_WORDS)}",
              "PullRequest.Title", "Configuration or deployment files may be modified", None,
              "Review configuration changes carefully and ensure no secrets are exposed", "security"),
        Check("FORK_CONTRIBUTION", "$repository.fork", "Repository.Fork", "Pull request is from a forked repository",
              None, "Review external contributions carefully for security and quality", "security"),
        Check("LOW_ENGAGEMENT", "$repository.stargazers_count = 0 AND $repository.forks_count = 0",
              "Repository.Activity", "Repository has no stars or forks, indicating low community engagement", None,
              "Consider repository visibility and community building strategies", "community"),
        Check("HIGH_ISSUE_RATIO", "$repository.open_issues_count > 100 AND $repository.stargazers_count < 50",
              "Repository.OpenIssues", "High number of open issues relative to repository popularity", None,
              "Consider issue triage and maintenance practices", "maintenance"),
        Check("SELF_ASSIGNED",
              f"$pull_request.user.login = $sender.login AND {count_of('$pull_request.assignees')} = 1"
              " AND coalesce(get($pull_request.assignees, 0).login, '') = $pull_request.user.login",
              "PullRequest.Assignees", "Pull request author assigned to their own PR", None,
              "Consider assigning to a team member for review", "workflow"),
        Check("NO_REVIEWERS",
              f"{count_of('$pull_request.requested_reviewers')} = 0 AND {count_of('$pull_request.requested_teams')} = 0"
              f" AND ({_CHANGES} > 100 OR $pull_request.changed_files > 5)",
              "PullRequest.Reviewers", "No reviewers requested for significant changes", None,
              "Request appropriate reviewers for code quality and knowledge sharing", "workflow"),
        Check("STALE_PR", f"{_AGE} > 168", "PullRequest.CreatedAt",
              "Pull request is {cast(" + _AGE + " / 24 AS BIGINT)} days old", None,
              "Consider rebasing, updating, or closing if no longer relevant", "workflow"),
        Check("MANY_COMMITS", "$pull_request.commits > 20", "PullRequest.Commits",
              "Pull request contains {$pull_request.commits} commits", "$pull_request.commits",
              "Consider squashing related commits for cleaner history", "maintainability"),
    ],
    title="GithubValidator",
    model_type="GitHubPayload",
    provider="github_validator",
    style="github",
    field_count="50",
)

COMMIT_AUTHOR = rule_set(
    "CommitAuthor",
    text("name", required, min=1, max=255),
    text("email", required, email=True),
    time("date", required),
    style="github",
)
COMMIT_REFERENCE = rule_set(
    "CommitReference", text("sha", required, len=40, hexadecimal=True), text("url", required, url=True), style="github",
)
COMMIT_STATS = rule_set(
    "CommitStats", integer("additions", gte=0), integer("deletions", gte=0), integer("total", gte=0), style="github",
)
COMMIT_FILE = rule_set(
    "CommitFile",
    text("filename", required, min=1),
    integer("additions", gte=0),
    integer("deletions", gte=0),
    integer("changes", gte=0),
    text("status", required, oneof="added removed modified renamed copied changed unchanged"),
    text("raw_url", required, url=True),
    text("blob_url", required, url=True),
    text("patch", optional, nullable=True),
    text("sha", required, len=40, hexadecimal=True),
    text("contents_url", required, url=True),
    style="github",
)
VERIFICATION = rule_set(
    "Verification",
    flag("verified"),
    text("reason", required,
         oneof="expired_key ocsp_pending ocsp_failure disabled_key unknown_signature_type unsigned unverified_email"
               " bad_email malformed_signature invalid gpg_error not_signing_key revoked_key no_user unknown_key"
               " bad_cert ocsp_revoked"),
    text("signature", nullable=True),
    text("payload", nullable=True),
    style="github",
)
COMMIT = rule_set(
    "Commit",
    record("author", COMMIT_AUTHOR, required),
    record("committer", COMMIT_AUTHOR, required),
    text("message", required, min=1, max=50000),
    record("tree", COMMIT_REFERENCE, required),
    text("url", required, url=True),
    integer("comment_count", gte=0),
    record("verification", VERIFICATION, optional, nullable=True),
    style="github",
)
COMMIT_DATA = rule_set(
    "CommitData",
    text("sha", required, len=40, hexadecimal=True),
    text("node_id", required, min=1),
    record("commit", COMMIT, required),
    text("url", required, url=True),
    text("html_url", required, url=True),
    text("comments_url", required, url=True),
    record("author", USER, optional, nullable=True),
    record("committer", USER, optional, nullable=True),
    records("parents", COMMIT_REFERENCE, optional),
    record("stats", COMMIT_STATS, optional, nullable=True),
    records("files", COMMIT_FILE, optional),
    style="github",
)
