"""DevOps rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

CONTAINER_FILES = {
    "Docker": [
        "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore",
        "docker-entrypoint.sh", ".docker", "docker-compose.override.yml", "docker-stack.yml",
    ],
    "Kubernetes": [
        "kubernetes/", "k8s/", "charts/", "manifests/", "deployment.yaml", "service.yaml",
        "ingress.yaml", "configmap.yaml", "statefulset.yaml", "daemonset.yaml", "job.yaml",
        "cronjob.yaml", "pod.yaml", "replicaset.yaml", "deployment.yml", "service.yml",
        "kustomization.yaml", "kustomization.yml", "Chart.yaml",
    ],
    "Helm": [
        "Chart.yaml", "values.yaml", "templates/", "charts/", "helm/", ".helmignore",
        "requirements.yaml",
    ],
    "Podman": ["podman-compose.yml", "podman-compose.yaml", "podman-docker-compose.yml"],
    "Buildah": ["buildah.sh", "buildah-script.sh"],
    "Skaffold": ["skaffold.yaml", "skaffold.yml"],
    "OpenShift": [
        "openshift/", "template.yaml", "template.yml", "buildconfig.yaml", "route.yaml",
        "route.yml", "imagestream.yaml", "imagestream.yml",
    ],
    "Istio": [
        "istio/", "VirtualService.yaml", "Gateway.yaml", "ServiceEntry.yaml",
        "DestinationRule.yaml", "EnvoyFilter.yaml",
    ],
    "Containerd": ["containerd.toml", "containerd.conf", "config.toml"],
    "Docker Swarm": ["docker-stack.yml", "docker-stack.yaml"],
    "Docker Compose": ["docker-compose.yml", "docker-compose.yaml"],
}

CICD_FILES = {
    "GitHub Actions": [
        ".github/workflows/", ".github/actions/", ".github/workflows/*.yml",
        ".github/workflows/*.yaml", "action.yml", "action.yaml",
    ],
    "GitLab CI": [".gitlab-ci.yml", ".gitlab-ci.yaml", ".gitlab/", "gitlab-ci.yml"],
    "Jenkins": [
        "Jenkinsfile", "jenkins/", "jenkins.yaml", "jenkins.yml", "pipeline.jenkins",
        "jenkins-pipeline.groovy",
    ],
    "Travis CI": [".travis.yml", ".travis.yaml"],
    "CircleCI": [".circleci/", ".circleci/config.yml", ".circleci/config.yaml", "circle.yml"],
    "Azure Pipelines": [
        "azure-pipelines.yml", "azure-pipelines.yaml", ".azure-pipelines/", ".azure-pipelines.yml",
        ".azure-pipelines.yaml",
    ],
    "AWS CodePipeline": ["buildspec.yml", "buildspec.yaml", "appspec.yml", "appspec.yaml"],
    "Bitbucket Pipelines": ["bitbucket-pipelines.yml", "bitbucket-pipelines.yaml"],
    "Bamboo": ["bamboo-specs/", "bamboo-specs.yml", "bamboo-specs.yaml"],
    "TeamCity": [".teamcity/", "teamcity-build.xml", "teamcity-settings.kts"],
    "Drone": [".drone.yml", ".drone.yaml"],
    "GoCD": [".gocd.yml", ".gocd.yaml"],
    "Concourse": ["pipeline.yml", "concourse/", "ci/pipeline.yml"],
    "ArgoCD": ["argocd/", "argo-cd/", "application.yaml", "application.yml"],
    "FluxCD": ["flux/", "flux-system/", "gotk-components.yaml", "kustomization.yaml"],
    "Tekton": ["tekton/", "task.yaml", "pipeline.yaml", "pipelinerun.yaml"],
    "Spinnaker": ["spinnaker/", "pipeline.json"],
}

IAC_FILES = {
    "Terraform": [
        "*.tf", "terraform/", "modules/", "terraform.tfstate", "terraform.tfvars", "variables.tf",
        "outputs.tf", "main.tf", ".terraform/", ".terraform.lock.hcl",
    ],
    "CloudFormation": [
        "*.template", "*.template.json", "*.template.yaml", "*.template.yml", "cloudformation/",
        "cf/", "stack.json", "stack.yaml", "stack.yml",
    ],
    "AWS CDK": ["cdk.json", "cdk.context.json", "cdk.out/", "lib/", "bin/cdk.ts"],
    "Pulumi": ["Pulumi.yaml", "Pulumi.yml", "pulumi/", "index.ts", "__main__.py", "Pulumi.*.yaml"],
    "Serverless Framework": [
        "serverless.yml", "serverless.yaml", "serverless.json", ".serverless/",
    ],
    "Ansible": [
        "ansible/", "playbooks/", "roles/", "inventory/", "hosts", "ansible.cfg", "site.yml",
        "main.yml", "requirements.yml", "tasks/",
    ],
    "Chef": [
        "chef/", "cookbooks/", "recipes/", "kitchen.yml", "Berksfile", "metadata.rb",
        "recipes/default.rb",
    ],
    "Puppet": ["puppet/", "manifests/", "modules/", "Puppetfile", "environments/", "site.pp"],
    "Salt": ["salt/", "pillar/", "states/", "reactor/", "top.sls", "Saltfile", "minion", "master"],
    "Packer": ["*.pkr.hcl", "packer.json", "templates/", "packer/"],
    "Vagrant": ["Vagrantfile", ".vagrant/"],
    "Bicep": ["*.bicep", "bicep/", "main.bicep", "modules/"],
    "AWS SAM": ["template.yaml", "sam.yaml", "samconfig.toml", "sam.toml"],
    "Crossplane": ["crossplane/", "composition.yaml", "definition.yaml"],
    "Kustomize": ["kustomization.yaml", "kustomization.yml", "kustomize/", "base/", "overlays/"],
}

MONITORING_FILES = {
    "Prometheus": [
        "prometheus.yml", "prometheus.yaml", "prometheus/", "rules/", "alerts.yml", "alerts.yaml",
        "rules.yml", "rules.yaml",
    ],
    "Grafana": [
        "grafana/", "dashboards/", "datasources/", "grafana.ini", "dashboard.json",
        "datasource.yaml", "datasource.yml",
    ],
    "ELK Stack": [
        "elasticsearch/", "kibana/", "logstash/", "elasticsearch.yml", "kibana.yml",
        "logstash.conf", "filebeat.yml", "metricbeat.yml",
    ],
    "Loki": ["loki/", "loki.yaml", "loki-config.yaml", "promtail.yaml"],
    "Jaeger": ["jaeger/", "jaeger.yaml", "tracing.yaml"],
    "New Relic": ["newrelic.yml", "newrelic.yaml", "newrelic.config.js"],
    "Datadog": ["datadog/", "datadog.yaml", "datadog.yml"],
    "Fluentd": ["fluentd/", "fluent.conf", "fluentd.conf"],
    "Graylog": ["graylog/", "graylog.conf", "graylog-server.json"],
    "StatsD": ["statsd/", "statsd.conf"],
}

CLOUD_FILES = {
    "AWS": [
        ".aws/", "aws-config.json", "aws/", "cloudformation/", "s3/", "lambda/", "ec2/", "ecs/",
        "eks/", "rds/",
    ],
    "Google Cloud": [
        ".gcp/", "gcp/", "gcloud/", "app.yaml", "cloudbuild.yaml", "cloudfunctions/", "appengine/",
        "gke/",
    ],
    "Azure": [
        "azure/", ".azure/", "azuredeploy.json", "azuredeploy.parameters.json", "arm-templates/",
        "azure-pipelines.yml",
    ],
    "Digital Ocean": [".do/", "digitalocean/", "do/"],
    "Heroku": ["Procfile", "app.json", "heroku.yml"],
    "IBM Cloud": [".bluemix/", "manifest.yml", "cloud-functions/"],
    "Alibaba Cloud": ["aliyun/", "acs/", "ros-templates/"],
    "Oracle Cloud": ["oci/", "oracle/", "oci-config"],
    "Vercel": ["vercel.json", ".vercel/", "now.json"],
    "Netlify": ["netlify.toml", ".netlify/"],
    "Firebase": ["firebase.json", ".firebaserc", "firestore.rules", "firestore.indexes.json"],
}

CONTENT = {
    "Docker": [
        r"FROM\s+\w+", r"WORKDIR\s+", r"EXPOSE\s+\d+", r"ENTRYPOINT\s+", r"VOLUME\s+", r"RUN\s+",
        "docker run", "docker-compose up",
    ],
    "Kubernetes": [
        "apiVersion:", r"kind:\s+Deployment", r"kind:\s+Service", "kubectl apply", "kubectl get",
        r"kind:\s+Pod", r"kind:\s+ConfigMap",
    ],
    "Terraform": [
        r'provider\s+\"', r'resource\s+\"', r'module\s+\"', r'variable\s+\"', r'output\s+\"',
        r"terraform\s+{", r"locals\s+{",
    ],
    "AWS": [
        r"aws_\w+", "AWS::CloudFormation::Stack", "AWS::Lambda::", "AWS::EC2::", "AWS::S3::",
        "AWS::DynamoDB::",
    ],
    "Google Cloud": [
        r"google_\w+", r"gcloud\s+", "GOOGLE_CLOUD", "GCP_", r"Google\s+Cloud\s+Platform",
    ],
    "Azure": [
        r"azurerm_\w+", r"az\s+", "AZURE_", "Microsoft.Storage", "Microsoft.Compute",
        "Microsoft.Network",
    ],
    "CI/CD": [
        "steps:", "jobs:", "pipeline:", "stages:", r"on:\s+push", r"on:\s+pull_request",
        "workflow_dispatch", "build:", "test:", "deploy:",
    ],
}

PACKER_SPECIFIC = [
    r'\"builders\":\s*\[', r'\"provisioners\":\s*\[', r'source\s+\".*\"\s+\".*\"\s+{', r"build\s+{",
]

# Sub-categories; a technology of no table is "other".
SUB_CATEGORIES = ["other", "containerization", "cicd", "iac", "monitoring", "cloud"]
